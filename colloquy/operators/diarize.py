"""Speakers by clustering of frames, for all recordings of a table in the same jobs.

What belongs to a recording is found from its own rows alone: scale and level by sums that merge, the number of
speakers from a bounded sample, clusters in portions of bounded size whose clusters, each a number and a mean,
are merged by Ward's rule. So no recording has to fit a task, and none changes another's result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small, written
from . import voices
from .timeline import fill_nearest, label_segments, median_smoothed, merge_same, merged_short

#: Frames of a recording from which the number of speakers is told, about.
SAMPLE = 3000
#: Frames of a portion for each method (a neighbour graph of an hour's voiced frames; Ward's rule takes n squared steps).
PORTION = {"spectral": 65_536, "hierarchical": 2048, "kmeans": 8192}
#: Tasks at most over which portions are dealt.
MOST_TASKS = 6000
#: Clusters that a portion, or several portions together, hand on; and portions that are merged at a time.
KEPT, TOGETHER = 128, 16


def _vector(c: str) -> Column:
    return array_to_vector(F.col(c).cast("array<double>"))


def _standard(values: Column, mean: Column, deviation: Column) -> Column:
    return F.transform(values, lambda x, i: (x - F.get(mean, i)) / F.get(deviation, i))


def standardised(frames: DataFrame, features: str = "features", key: str | None = None) -> DataFrame:
    """frames plus `scaled`: features with mean 0 and deviation 1 over the recording, or over all frames without a key.

    Deviations are those of a sample without a key, of the whole with one; a feature that never changes is 0.
    """
    found = frames.groupBy(*([key] if key else [])).agg(Summarizer.metrics("mean", "variance", "count").summary(_vector(features)).alias("_s"))
    n = F.col("_s.count")
    share = (n - 1) / n if key else F.lit(1.0)
    deviation = F.transform(vector_to_array("_s.variance"), lambda v: F.when(v > 0, F.sqrt(v * share)).otherwise(F.lit(1.0)))
    facts = found.select(*([F.col(key).alias("_k")] if key else []), vector_to_array("_s.mean").alias("_mean"), deviation.alias("_deviation"))
    values = F.col(features).cast("array<double>")
    if not key:
        row = facts.first()  # a number for each feature
        return frames.withColumn("scaled", _standard(values, *(F.array(*map(F.lit, row[c] or [])) for c in ("_mean", "_deviation"))))
    met = frames.join(small(written(facts, "scales")), F.col(key).eqNullSafe(F.col("_k")))
    return met.withColumn("scaled", _standard(values, F.col("_mean"), F.col("_deviation"))).select(*frames.columns, "scaled")


def voiced(frames: DataFrame, key: str, level: str = "rms", share: float = 0.2) -> DataFrame:
    """frames plus `voiced`: whether the level is above the key's given percentile."""
    levels = frames.groupBy(key).agg(F.percentile(level, F.lit(share)).alias("_level")).withColumnRenamed(key, "_k")
    return frames.join(small(written(levels, "levels")), F.col(key).eqNullSafe(F.col("_k"))).withColumn("voiced", F.col(level) > F.col("_level")).select(*frames.columns, "voiced")


def _by_lot(key: str, order: str, *salt: str) -> Column:
    """A number for each frame that depends on the recording and the frame alone."""
    return F.xxhash64(key, order, *(F.lit(s) for s in salt))


def _matrix(column: pa.ChunkedArray, turn: np.ndarray | None = None) -> np.ndarray:
    """The vectors as rows, in this turn if one is given."""
    if not len(column):
        return np.zeros((0, 0))
    rows = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1).astype(float, copy=False)
    return rows if turn is None else rows[turn]


def _told(group: pa.Table, names: list[str]) -> pa.Table:
    """These columns of a group, vectors as lists whose numbers may be null, as a declared schema has them."""
    group = group.select(names)
    at = group.schema.get_field_index("v")
    return group.set_column(at, "v", group["v"].cast(pa.list_(pa.float64())))


def speakers_of(points: DataFrame, key: str, order: str = "i", column: str = "scaled", tell: Callable[[np.ndarray], int] = voices.speakers) -> DataFrame:
    """(key, speakers): how many each recording has, told from about SAMPLE of its frames, which a hash draws.

    points has the frames to be clustered, each with a vector as an array. tell sees a matrix, a row for each frame in
    the hash's order.
    """
    lots = 1 << 20
    n = points.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed(key, "_k")
    lot = _by_lot(key, order, "sample")
    some = points.join(small(written(n, "sizes")), F.col(key).eqNullSafe(F.col("_k"))).where(F.pmod(lot, F.lit(lots)) * F.col("_n") < lots * SAMPLE)
    kind = points.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["lot"].to_numpy(), kind="stable")
        return pa.table({key: group[key].slice(0, 1), "speakers": pa.array([tell(_matrix(group["v"])[order])], pa.int32())})

    return some.select(key, lot.alias("lot"), F.col(column).cast("array<double>").alias("v")).groupBy(key).applyInArrow(run, f"{key} {kind}, speakers int")


_WITHIN: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "spectral": voices.spectral,
    "hierarchical": lambda x, k: voices.ward(np.ones(len(x)), x, max(k, KEPT)),
    "kmeans": lambda x, k: voices.kmeans(x, max(k, KEPT)) if len(x) > max(k, KEPT) else np.arange(len(x)),
}


def clustered(points: DataFrame, key: str, speakers: DataFrame | int, method: str = "spectral", order: str = "i", column: str = "scaled") -> DataFrame:
    """points plus label, from 0 in the order in which a recording's clusters first come.

    speakers is the number of clusters, or a table (key, speakers). method: spectral (the Laplacian of a graph of nearest
    neighbours), hierarchical (Ward's rule) or kmeans. A recording is dealt by hash into portions of at most about
    PORTION frames; each is clustered in a task of its own, and the clusters of all portions, as numbers and means, are merged
    by Ward's rule (kmeans: by weighted k-means), TOGETHER portions at a time, until as many are left as there are
    speakers. One portion's result is the method's own. Recordings of fewer frames than speakers have as many clusters as frames.
    """
    kind = points.schema[key].dataType.simpleString()
    n = points.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed(key, "_k")
    facts = n.withColumn("_speakers", F.lit(speakers)) if isinstance(speakers, int) else n.join(speakers.select(F.col(key).alias("_k2"), F.col("speakers").alias("_speakers")), F.col("_k").eqNullSafe(F.col("_k2"))).drop("_k2")
    facts = facts.withColumn("_portions", F.ceil(F.col("_n") / PORTION[method]))
    facts = written(facts.select("_k", F.col("_speakers").cast("int").alias("_speakers"), F.col("_portions").cast("int").alias("_portions")), "recordings")
    lot = F.pmod(_by_lot(key, order), F.col("_portions")).cast("int").alias("portion")
    dealt = points.join(small(facts), F.col(key).eqNullSafe(F.col("_k"))).select(key, F.col(order).cast("long").alias("at"), lot, F.col("_speakers").alias("k"), F.col(column).cast("array<double>").alias("v"))
    within = _WITHIN[method]

    def portion(group: pa.Table) -> pa.Table:
        turn = np.argsort(group["at"].to_numpy(), kind="stable")
        labels = np.unique(within(_matrix(group["v"], turn), group["k"][0].as_py()), return_inverse=True)[1]
        return _told(group.take(pa.array(turn)).append_column("part", pa.array(labels.astype(np.int32))), [key, "at", "portion", "k", "part", "v"])

    tasks = 3 * (facts.agg(F.sum("_portions")).first()[0] or 1)  # else small portions, which take long, would share a task
    dealt = dealt.repartition(min(tasks, MOST_TASKS), key, "portion")
    members = written(dealt.groupBy(key, "portion").applyInArrow(portion, f"{key} {kind}, at long, portion int, k int, part int, v array<double>"), "portions")
    mean = vector_to_array(Summarizer.metrics("mean").summary(array_to_vector("v"))["mean"])
    parts = members.groupBy(key, "portion", "part", "k").agg(F.count("*").alias("n"), mean.alias("v"))

    def merged(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("portion", "ascending"), ("part", "ascending")])
            size, means, k = group["n"].to_numpy().astype(float), _matrix(group["v"]), group["k"][0].as_py()
            if method == "kmeans" and last:
                labels = voices.kmeans(means, k, size)
            else:
                labels = voices.ward(size, means, k if last else max(k, KEPT))
            return _told(group.append_column("label", pa.array(labels.astype(np.int32))), [key, "portion", "part", "k", "n", "v", "label"])

        return run

    ddl = f"{key} {kind}, portion int, part int, k int, n long, v array<double>, label int"
    names = None  # (key, portion, part) of a frame's own portion and the cluster, of what lot, that it has come to
    most = facts.agg(F.max("_portions")).first()[0] or 0
    while True:
        last = most <= TOGETHER
        lots = F.lit(0) if last else F.floor(F.col("portion") / TOGETHER).cast("int")
        step = written(parts.withColumn("lot", lots).groupBy(key, "lot").applyInArrow(merged(last), ddl), "merged")
        to = step.select(F.col(key).alias("_k"), F.col("portion").alias("_p"), F.col("part").alias("_c"), (F.lit(0) if last else F.floor(F.col("portion") / TOGETHER).cast("int")).alias("_to"), F.col("label").alias("_label"))
        if names is None:
            names = to
        else:
            old = names.select(F.col("_k").alias("k_"), F.col("_p").alias("p_"), F.col("_c").alias("c_"), F.col("_to").alias("to_"), F.col("_label").alias("label_"))
            names = old.join(to, F.col("k_").eqNullSafe(F.col("_k")) & (F.col("to_") == F.col("_p")) & (F.col("label_") == F.col("_c"))).select(F.col("k_").alias("_k"), F.col("p_").alias("_p"), F.col("c_").alias("_c"), "_to", "_label")
        if last:
            break
        weighed = step.withColumn("portion", F.floor(F.col("portion") / TOGETHER).cast("int")).withColumn("weight", F.col("n").cast("double"))
        middle = vector_to_array(Summarizer.metrics("mean").summary(array_to_vector("v"), F.col("weight"))["mean"])
        parts = weighed.groupBy(key, "portion", F.col("label").alias("part"), "k").agg(F.sum("n").alias("n"), middle.alias("v"))
        most = -(-most // TOGETHER)
    met = members.select(key, "at", "portion", "part").join(small(names), F.col(key).eqNullSafe(F.col("_k")) & (F.col("portion") == F.col("_p")) & (F.col("part") == F.col("_c")))
    labels = written(met.select(F.col(key).alias("_k"), F.col("at").alias("_at"), F.col("_label").alias("_own")), "labels")
    first = labels.groupBy("_k", "_own").agg(F.min("_at").alias("_first"))
    rank = written(first.select(F.col("_k").alias("_k2"), F.col("_own").alias("_own2"), (F.row_number().over(Window.partitionBy("_k").orderBy("_first")) - 1).alias("label")), "ranks")
    ranked = labels.join(small(rank), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_own") == F.col("_own2"))).select("_k", "_at", "label")
    return points.join(ranked, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_at"))).select(*points.columns, "label")


def diarize(frames: DataFrame, key: str, duration: str = "duration", speakers: int | None = None, method: str = "spectral", hop: int = 512, rate: int = 16000) -> DataFrame:
    """(key, idx, start, end, speaker) of every recording's frames (i, features, rms, duration; i unique in a recording).

    Frames above the 20th percentile of their recording's level are clustered; the others take the nearest one's label;
    labels are smoothed and turned into segments; short ones are merged. Speakers are numbered in the order in which they are
    first heard. A recording of fewer than ten voiced frames has no segment, nor has an empty table.
    """
    raw = written(frames.select(key, "i", "features", "rms", duration), "frames")  # features cost more than all that follows
    at = voiced(standardised(raw, key=key), key)
    enough = at.where("voiced").groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 10").select(F.col(key).alias("_k"))
    own = at.join(small(written(enough, "long_enough")), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    points = own.where("voiced").select(key, "i", "scaled")
    labels = clustered(points, key, speakers if speakers else written(speakers_of(points, key), "speakers"), method).select(F.col(key).alias("_k"), F.col("i").alias("_i"), "label")
    every = own.select(key, "i", duration, "voiced").join(labels, F.col(key).eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i")), "left").select(key, "i", duration, "voiced", "label")
    smooth = median_smoothed(fill_nearest(every, key, "i", "label", F.col("voiced")), key, "i", "label")
    return merge_same(merged_short(label_segments(smooth, key, hop, rate, duration=duration), key, 0.3), key)

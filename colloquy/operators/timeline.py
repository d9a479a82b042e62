"""Timelines: runs of labels, speakers of segments, participation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, order: str | list[str], label: str) -> DataFrame:
    """rows plus `run`: the number of label changes so far within the key (0 at first)."""
    w = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1)).cast("int")
    return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def label_segments(frames: DataFrame, key: str, hop: int = 512, rate: int = 16000, frame: str = "i", label: str = "label", duration: str = "duration") -> DataFrame:
    """(key, idx, start, end, speaker): frames' label runs; each ends where the next begins, the last at the duration."""
    at = runs(frames, key, frame, label).groupBy(key, "run").agg(F.min(frame).alias("first"), F.first(label).alias("label"), F.max(duration).alias("duration"))
    w = Window.partitionBy(key).orderBy("run")
    start = F.when(F.col("run") == 0, F.lit(0.0)).otherwise(F.col("first") * hop / rate)
    end = F.coalesce(F.lead("first").over(w) * hop / rate, F.col("duration"))
    return at.select(key, F.col("run").cast("int").alias("idx"), F.bround(start, 2).alias("start"), F.bround(end, 2).alias("end"), F.format_string("SPEAKER_%02d", F.col("label").cast("int")).alias("speaker"))


def merge_same(segments: DataFrame, key: str) -> DataFrame:
    """(key, idx, start, end, speaker): neighbours of one speaker as one segment, from the first's start to the last's end."""
    joined = runs(segments, key, "idx", "speaker").groupBy(key, "run")
    return joined.agg(F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.first("speaker").alias("speaker")).select(key, F.col("run").cast("int").alias("idx"), "start", "end", "speaker")


def merge_short(segments: Column, least: float = 0.5) -> Column:
    """An array of (start, end, speaker), in order, without short segments.

    A segment of the last one's speaker extends it. A short one, where two or more are there already, extends the
    last but one if that is its speaker's, whereupon the last goes, or else the last. Others are added.
    """
    piece = lambda s, end: F.struct(s["start"].alias("start"), end.alias("end"), s["speaker"].alias("speaker"))

    def add(kept: Column, s: Column) -> Column:
        n = F.size(kept)
        last, before = F.try_element_at(kept, F.lit(-1)), F.try_element_at(kept, F.lit(-2))
        but = lambda k: F.slice(kept, F.lit(1), F.greatest(n - k, F.lit(0)))
        short = (s["end"] - s["start"] < least) & (n > 1)
        return (
            F.when(n == 0, F.array(piece(s, s["end"])))
            .when(last["speaker"] == s["speaker"], F.concat(but(1), F.array(piece(last, s["end"]))))
            .when(short & (before["speaker"] == s["speaker"]), F.concat(but(2), F.array(piece(before, s["end"]))))
            .when(short, F.concat(but(1), F.array(piece(last, s["end"]))))
            .otherwise(F.concat(kept, F.array(piece(s, s["end"]))))
        )

    return F.aggregate(segments, F.array().cast("array<struct<start:double,end:double,speaker:string>>"), add)


def _without_short(starts: list, ends: list, speakers: list, least: float) -> tuple[list, list, list]:
    """What `merge_short` keeps, found in one pass: each segment is added, extends what is kept last, or takes that off."""
    start, end, speaker = [], [], []
    same = lambda a, b: a is not None and a == b
    for s, e, who in zip(starts, ends, speakers):
        n = len(start)
        short = n > 1 and s is not None and e is not None and e - s < least
        if n and same(speaker[-1], who):
            end[-1] = e
        elif short:
            if same(speaker[-2], who):
                del start[-1], end[-1], speaker[-1]
            end[-1] = e
        else:
            start.append(s), end.append(e), speaker.append(who)
    return start, end, speaker


def merged_short(segments: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, idx, start, end, speaker) after `merge_short`, for segments in rows. A key's segments go through one pass in one task."""
    kind = segments.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("idx", "start", "end", "speaker")])
        start, end, speaker = _without_short(*(group[c].to_pylist() for c in ("start", "end", "speaker")), least)
        own = pa.array(np.zeros(len(start), np.int64))
        return pa.table({key: group[key].take(own), "idx": pa.array(range(len(start)), pa.int32()), "start": pa.array(start, pa.float64()), "end": pa.array(end, pa.float64()), "speaker": pa.array(speaker, pa.string())})

    rows = segments.select(key, "idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker")
    return rows.groupBy(key).applyInArrow(run, f"{key} {kind}, idx int, start double, end double, speaker string")


def flag_overlaps(segments: DataFrame, key: str, gap: float = 0.1) -> DataFrame:
    """segments plus overlap: whether the next begins, or the last ended, less than `gap` away."""
    w = Window.partitionBy(key).orderBy("idx")
    after, before = F.lead("start").over(w) - F.col("end") < gap, F.col("start") - F.lag("end").over(w) < gap
    return segments.withColumn("overlap", F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False)))


def assign_speakers(segments: DataFrame, speakers: DataFrame, key: str, default: str = "SPEAKER_00", bin_seconds: float = 60.0) -> DataFrame:
    """segments plus speaker: that of the key's first speaker span (by idx) that holds the segment's start, ends included.

    Both sides meet in an equi-join on key and time bin: a span is in every bin that it touches, a start in one. So
    a long meeting is many join keys, and no span meets starts far from it.
    """
    own = segments.drop("speaker").withColumn("_bin", F.floor(F.col("start_time") / bin_seconds)).withColumn("_row", F.monotonically_increasing_id())
    spans = speakers.select(F.col(key).alias("_k"), F.col("idx").alias("_idx"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("speaker").alias("_speaker"), F.explode(F.sequence(F.floor(F.col("start") / bin_seconds), F.floor(F.col("end") / bin_seconds))).alias("_b"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & F.col("start_time").between(F.col("_s"), F.col("_e"))
    met = own.join(spans, inside, "left")
    rest = [c for c in own.columns if c not in ("_bin", "_row")]
    first = met.groupBy("_row", *rest).agg(F.min_by("_speaker", "_idx").alias("speaker"))
    return first.select(*rest, F.coalesce("speaker", F.lit(default)).alias("speaker"))


def participants(segments: DataFrame, key: str) -> DataFrame:
    """(key, participants): different speakers, a missing one being one more."""
    return segments.groupBy(key).agg(F.count_distinct(F.coalesce("speaker", F.lit("unknown"))).alias("participants"))


def participation(segments: DataFrame, key: str, duration: Column | None = None) -> DataFrame:
    """(key, speaker, duration, count, percentage) of each speaker; percentages of a key add up to 100 unless all durations are 0."""
    length = duration if duration is not None else F.coalesce("end_time", F.lit(0.0)) - F.coalesce("start_time", F.lit(0.0))
    own = segments.select(key, F.coalesce("speaker", F.lit("unknown")).alias("speaker"), length.alias("d"))
    sums = own.groupBy(key, "speaker").agg(F.sum("d").alias("duration"), F.count("*").alias("count"))
    total = F.sum("duration").over(Window.partitionBy(key))
    return sums.withColumn("percentage", F.when(total > 0, F.col("duration") / total * 100).otherwise(F.lit(0.0)))


def participation_segments(segments: DataFrame, key: str) -> DataFrame:
    """(key, speaker, segments): each speaker's stretches (start, end) in order; one row holds a speaker's of one meeting."""
    own = segments.select(key, F.coalesce("speaker", F.lit("unknown")).alias("speaker"), F.coalesce("start_time", F.lit(0.0)).alias("start"), F.coalesce("end_time", F.lit(0.0)).alias("end"))
    return own.groupBy(key, "speaker").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))


def voice_runs(frames: DataFrame, key: str, order: str, loud: Column, start: Column, end: Column, least: float = 0.5) -> DataFrame:
    """(key, start, end): runs of loud frames of at least so many seconds."""
    marked = runs(frames.withColumn("_loud", loud).withColumn("_s", start).withColumn("_e", end), key, order, "_loud").where("_loud")
    found = marked.groupBy(key, "run").agg(F.min("_s").alias("start"), F.max("_e").alias("end"))
    return found.where(F.col("end") - F.col("start") >= least).select(key, "start", "end")


def fill_nearest(frames: DataFrame, key: str, order: str, label: str, known: Column) -> DataFrame:
    """frames with the label of the nearest known frame where it is not known; of two as near, the later one's."""
    w = Window.partitionBy(key).orderBy(order)
    # what lies ahead is what lies behind in the opposite order: a frame of all that follows is gone through anew for each row
    back, ahead = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_n"), F.desc("_n")))
    at = frames.withColumn("_n", F.row_number().over(w)).withColumn("_l", F.when(known, F.col(label))).withColumn("_p", F.when(known, F.col("_n")))
    left, right = F.last("_p", True).over(back), F.last("_p", True).over(ahead)
    label_left, label_right = F.last("_l", True).over(back), F.last("_l", True).over(ahead)
    nearer = F.when(right.isNull() | (F.col("_n") - left < right - F.col("_n")), label_left).otherwise(label_right)
    return at.withColumn(label, F.coalesce("_l", nearer)).drop("_n", "_l", "_p")


def median_smoothed(frames: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """frames with each label replaced by the median of the five around it; beyond the ends the sequence is mirrored."""
    w = Window.partitionBy(key).orderBy(order)
    around = F.array(*(F.coalesce(F.lag(label, -k).over(w) if k < 0 else F.lead(label, k).over(w), _mirrored(label, w, k)) for k in (-2, -1, 0, 1, 2)))
    return frames.withColumn("_m", F.array_sort(around)[2]).drop(label).withColumnRenamed("_m", label)


def _mirrored(label: str, w, k: int) -> Column:
    """The label k places away with the ends mirrored (the end itself comes twice); only asked for where k leaves the key."""
    n, at = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.row_number().over(w)
    place = at + k
    place = F.when(place < 1, 1 - place).when(place > n, 2 * n + 1 - place).otherwise(place)
    shift = place - at
    return F.coalesce(*(F.when(shift == s, F.lag(label, -s).over(w) if s <= 0 else F.lead(label, s).over(w)) for s in range(-4, 5)), F.col(label))


def running_offsets(chunks: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """chunks plus offset: what came before within the key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def meeting_duration(segments: DataFrame, key: str) -> DataFrame:
    """(key, duration): whole seconds at which the last segment ends."""
    return segments.groupBy(key).agg(F.coalesce(F.max_by("end_time", "idx"), F.lit(0.0)).cast("int").alias("duration"))


def level_meter(rms: Column) -> Column:
    """struct(rms, db, speech) of a chunk's root mean square; what is no number counts as silence."""
    r = F.when(rms.isNull() | F.isnan(rms.cast("double")), F.lit(0.0)).otherwise(rms.cast("double"))
    return F.struct(r.alias("rms"), (20 * F.log10(r + 1e-10)).alias("db"), (r > 0.03).alias("speech"))

"""Centroid clustering by sort-means, on whole numbers, so that every round is exact wherever its rows lie.

A vector starts from the centroid it had last. The other centroids are looked at in ascending order of their distance
from that one; those strictly beyond twice the vector's own distance can't be nearer nor tie, by the triangle
inequality, and end the scan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import lean, release, table

#: Rows whose sums are taken in 64 bits before they go on as a row for each cluster.
PORTION = 1 << 14
_HALF = 31


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors of exactly dims components, none null, infinite or not a number; x is floor(scale * component)."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    real = F.transform("embedding", lambda v: v.cast("double"))
    kept = vectors.select("vec_id", real.alias("e")).where((F.size("e") == dims) & F.forall("e", finite))
    return kept.select("vec_id", F.transform("e", lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))


def lot(vec_id: Column, seed: int) -> Column:
    """The text whose hash decides which vectors are the first centroids; a null id counts as an empty one."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed) of each row of x, from the cluster that it had before; a tie goes to the smaller number."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1)
    cluster, distance, looked = before.copy(), np.empty(len(x), np.int64), 0
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = ((x[rows] - centroids[c]) ** 2).sum(-1)
        best, which, live = own.copy(), np.full(len(rows), c), np.arange(len(rows))
        looked += len(rows)
        for j in np.argsort(apart[c], kind="stable"):
            if j == c:
                continue
            live = live[apart[c, j] <= 4 * own[live]]  # squares: up to twice the distance
            if not len(live):
                break
            d = ((x[rows[live]] - centroids[j]) ** 2).sum(-1)
            looked += len(live)
            nearer = (d < best[live]) | ((d == best[live]) & (j < which[live]))
            best[live[nearer]], which[live[nearer]] = d[nearer], j
        cluster[rows], distance[rows] = which, best
    return cluster, distance, looked


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, x, cluster) with the clusters and distances under these centroids."""
    dims = centroids.shape[1]
    most = math.isqrt((1 << 61) // dims) // 2  # so that a squared distance is a long
    schema = rows.select("vec_id", "x", F.col("cluster").cast("int"), F.lit(0).cast("long").alias("distance")).schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            if x.size and max(abs(int(x.min())), abs(int(x.max()))) > most:
                raise ValueError(f"a component beyond {most} in whole numbers: its squared distance is no 64-bit number")
            cluster, distance, _ = assign(x, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=schema.names)

    return rows.select("vec_id", "x", "cluster").mapInArrow(run, schema)


def _sums(assigned: DataFrame, dims: int) -> dict[int, list[int]]:
    """For each cluster that has vectors: their number, their distances' sum and their components' sums, all exact.

    Tasks hand on one row for each cluster and portion; the merge has a row for each cluster and component.
    """

    @lean
    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PORTION):
                batch = whole.slice(start, PORTION)
                x, cluster, distance = _matrix(batch.column(0), dims), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                order = np.argsort(cluster, kind="stable")
                names, starts, n = np.unique(cluster[order], return_index=True, return_counts=True)
                halves = np.stack([distance & ((1 << _HALF) - 1), distance >> _HALF], axis=1)
                sums = np.add.reduceat(np.concatenate([halves, x], axis=1)[order], starts, axis=0)
                yield pa.RecordBatch.from_pydict({"cluster": pa.array(names, pa.int32()), "v": pa.array(np.concatenate([n[:, None], sums], axis=1).tolist(), pa.list_(pa.int64()))})

    each = assigned.select("x", "cluster", "distance").mapInArrow(portions, "cluster int, v array<long>")
    merged = each.select("cluster", F.posexplode("v").alias("i", "v")).groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, list[int]] = {}
    for row in sorted(merged.collect()):  # clusters times components
        out.setdefault(row["cluster"], []).append(int(row["v"]))
    return {c: [n, low + (high << _HALF), *sums] for c, (n, low, high, *sums) in out.items()}


def sort_means(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((vec_id, x, cluster, distance) of every kept vector, (cluster, centroid, n, inertia) of every centroid).

    vectors has vec_id and embedding, a list of numbers; its other columns are not used. Kept are those of exactly
    dims finite components, each made the whole number x = floor(scale * component). The first centroids are the k
    vectors with the smallest hashes of seed and id (of one id that repeats, the smaller x first); fewer vectors
    than k are as many centroids. Each round assigns all vectors to the nearest centroid, the smaller number
    where two are as near, and moves every centroid that has vectors to the floor of their mean. Then they are
    assigned once more. Repeated rows count each. No kept vector gives two empty tables. A component so large that a
    squared distance is no 64-bit number raises an error.

    Only k centroids and their sums pass the driver. A round reads the last one's table and writes its own;
    nothing else is shuffled than a row for each cluster and portion of rows.
    """
    spark = vectors.sparkSession
    base = whole_numbers(vectors, dims, scale)
    first = base.select(lot(F.col("vec_id"), seed).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    now = base.withColumn("cluster", F.lit(0).cast("int"))
    sums: dict[int, list[int]] = {}
    if len(centroids):
        last = None
        for turn in range(rounds + 1):
            now = table(_assigned(now, centroids), "sort_means")
            sums = _sums(now, dims)
            if last is not None:
                release(last)
            last = now
            if turn < rounds:
                for c, (n, _, *total) in sums.items():
                    centroids[c] = [t // n for t in total]
    else:
        now = now.withColumn("distance", F.lit(0).cast("long")).where("false")
    told = [(c, x.tolist(), *sums.get(c, [0, 0])[:2]) for c, x in enumerate(centroids)]
    return now, spark.createDataFrame(told, "cluster int, centroid array<long>, n long, inertia long")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    told = centroids.collect()  # k rows
    rows = [(r["cluster"], r["inertia"], sum(x["inertia"] for x in told), hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in told]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("x").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    steps = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT v.r, c{i}.c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, list(f ORDER BY i) AS x FROM (
  SELECT a.m.c AS c, i, CAST((sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
  FROM a{i} AS a JOIN v USING (r), unnest(range(1, 65)) AS u(i) GROUP BY a.m.c, i) GROUP BY c)""")
            steps.append(f"c{i + 1} AS (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, CAST(a.m.c AS INTEGER) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON c.c = a.m.c"""


ORACLE = _oracle()

"""Tables that cut lineage, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OPEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the setting is absent, a session on one machine gets a folder of its own;
    on a cluster that is an error, as executors would each write to a disk that the others don't see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _OPEN:
        atexit.register(_remove_all)
    _OPEN[path] = spark
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again: lineage ends here and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what `table` wrote for these; nothing that is yet to run may read them."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path in _OPEN:
            remove(_OPEN.pop(path), path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for path, spark in _OPEN.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; its cluster's own cleaning remains
            return


def plus(df: DataFrame, ddl: str) -> StructType:
    """df's schema with the columns of ddl after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def free(df: DataFrame, *names: str) -> list[str]:
    """A name for each of the given ones that no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a looked-up table that are broadcast at most, of about a hundred bytes each.
MOST_BROADCAST = 50_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcasting if it has at most `most` rows; else a join with it shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def look_up(rows: DataFrame, keyed: DataFrame, key: str, times: str, how: str = "left", most: int | None = None) -> DataFrame:
    """rows joined (left or inner) with keyed, which has one row for each value of `key` and in `times` how many of rows have it.

    A keyed of `most` rows (MOST_BROADCAST) is broadcast. A larger one meets rows in a shuffle, but for the keys that
    more than one in `most` of rows have: those are fewer than `most`, so they are broadcast and no task takes a hot
    key's rows. Rows with a null key meet nothing and are not shuffled.
    """
    most = MOST_BROADCAST if most is None else most
    keyed = keyed.where(F.col(key).isNotNull())
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), key, how)
    share = keyed.agg(F.sum(times)).first()[0] // max(1, most) + 1
    hot, cold = F.broadcast(keyed.where(F.col(times) >= share)), keyed.where(F.col(times) < share)
    full = rows.where(F.col(key).isNotNull())
    out = full.join(hot, key).unionByName(full.join(hot, key, "left_anti").join(cold, key, how))
    if how == "inner":
        return out
    bare = rows.where(F.col(key).isNull())
    return out.unionByName(bare.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema if f.name != key)))


def lean(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A step over Arrow batches that gives its memory back when a task ends: workers live on through many stages, and
    what their allocators keep would add to the next stage's need."""

    @functools.wraps(step)
    def run(*given) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(*given)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library than glibc
                pass

    return run

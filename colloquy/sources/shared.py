"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most where a table's size is only known when it runs.
MOST_BROADCAST = 20_000


def folder(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, below spark.checkpoint.dir. Where that is unset, a session on one machine gets a
    folder of its own; on a cluster it is an error, as executors would each write to a disk that the others don't see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again: a lost executor costs no recomputation of what comes before."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcasting if it has at most `most` rows; else a join with it shuffles, and skewed parts of it are split."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

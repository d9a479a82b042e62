"""Shards by jump consistent hashing: a key and the number of shards decide, and no ring table is kept.

The key's stream of pseudo-random jumps is followed until it leaves the shards; where it last stood is the shard. The
place it jumped to tells what one more shard would take. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import free, release, table

#: The multiplier of the published algorithm's generator, in two halves; the lower one as a signed number.
FACTOR = 2862933555777941757
_HIGH, _LOW = FACTOR >> 32, FACTOR & 0xFFFFFFFF
_MASK = 0xFFFFFFFF
#: Jumps that are followed for every key; a key needs ln(shards) of them on average, and those that need more go on.
JUMPS = 8


def _next(state: Column, shards: int) -> Column:
    """One jump, unless the last one has left the shards.

    The generator's product is taken modulo 2**64 in parts, of which none leaves a long: sessions may hold overflow to be an error.
    """
    long = lambda n: F.lit(n).cast("long")
    low, high = state["low"], state["high"]
    first = low.bitwiseAND(long(0xFFFF)) * long(_LOW) + long(1)
    second = F.shiftrightunsigned(low, 16) * long(_LOW) + F.shiftrightunsigned(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(long(0xFFFF)), 16).bitwiseOR(first.bitwiseAND(long(0xFFFF)))
    carry = F.shiftrightunsigned(second, 16) + low * long(_HIGH)
    new_high = (carry.bitwiseAND(long(_MASK)) + (high * long(_LOW - (1 << 32))).bitwiseAND(long(_MASK))).bitwiseAND(long(_MASK))
    to = F.floor((state["to"] + long(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(new_high, 1) + long(1)).cast("double")))
    jumped = F.struct(new_low.alias("low"), new_high.alias("high"), state["to"].alias("at"), to.alias("to"))
    return F.when(state["to"] < long(shards), jumped).otherwise(state)


def jump(key: Column, shards: int) -> Column:
    """struct(at, to): the shard of a key (any type; its text counts, a null is a key of its own), and the place beyond the shards that it would jump to.

    The key's 64 bits are the first half of the MD5 of its text, which every engine computes alike.
    """
    digest = F.coalesce(F.md5(key.cast("string").cast("binary")), F.md5(F.lit("null key").cast("binary")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    start = F.struct(part(9).alias("low"), part(1).alias("high"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    follow = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: _next(s, shards))
    some = follow(start, min(JUMPS, shards))
    if shards <= JUMPS:  # each jump goes up by one at least
        return some
    return F.when(some["to"] < F.lit(shards).cast("long"), follow(some, shards - JUMPS)).otherwise(some)


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """docs plus size, text_crc32, law, shard and grown_shard, replacing columns of these names; nothing is shuffled.

    size is the text's UTF-8 bytes plus 16 (a null text has none, and the checksum of nothing, 0). Rows of one key go to
    one shard, so repeated rows do; a null key is a key of its own. grown_shard is the shard when there is one more:
    the same or the new one.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    own = docs.drop("size", "text_crc32", "law", "shard", "grown_shard")
    (at,) = free(own, "jump")
    out = own.withColumn(at, jump(F.col(key), shards))
    text = F.coalesce("text", F.lit(""))
    grown = F.when(F.col(at)["to"] == shards, F.lit(shards)).otherwise(F.col(at)["at"].cast("int"))
    return out.select(
        *own.columns,
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(at)["at"].cast("int").alias("shard"),
        grown.alias("grown_shard"),
    )


def slotted(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with shard) plus slot, a long: their places in their shards, from 0 without gaps, in order of the given columns, nulls first.

    Rows are sorted over the whole cluster by shard, the given columns and the row's own number, so that no shard, key or
    run of equal rows has to fit a task. A row's place in its sorted part, the number of the shard's rows in the
    parts before it, and so the slot, are then known from a count for each part and shard: parts plus shards rows,
    which are broadcast. An empty table has no slots.
    """
    own = rows.drop("slot")
    salt, at, in_shard, in_part, start = free(own, "salt", "place", "in_shard", "in_part", "start")
    once = table(own.withColumn(salt, F.monotonically_increasing_id()), "shards")  # texts are read once, not again for the sort's sample
    ways = ["shard", *order, salt]
    placed = table(once.repartitionByRange(*ways).sortWithinPartitions(*ways).withColumn(at, F.monotonically_increasing_id()), "slots")
    release(once)
    part = F.shiftrightunsigned(F.col(at), 33)
    counts = placed.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias(in_shard), F.col("part").alias(in_part), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias(start))
    met = placed.join(F.broadcast(starts), (F.col("shard") == F.col(in_shard)) & (part == F.col(in_part)))
    return met.select(*own.columns, (F.col(start) + F.col(at)).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 1) -> None:
    """Writes docs as Parquet, a folder for each shard with at most `files` files, over which a shard's rows are spread evenly."""
    out = assign(docs, shards, key)
    (salt,) = free(out, "salt")
    out = out.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    out.repartition(shards * files, "shard", salt).drop(salt).write.partitionBy("shard").parquet(path)


def op13_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = assign(docs, 40).drop("text")
    return slotted(rows, "doc_id", "size", "text_crc32").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE = f"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), md5('null key')) AS digest,
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes
  FROM documents),
sums AS (
  SELECT doc_id, size, digest, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM docs, bits),
jumps AS (
  SELECT digest, CAST('0x' || substr(digest, 1, 16) AS UHUGEINT) AS k, CAST(-1 AS BIGINT) AS stood, CAST(0 AS BIGINT) AS place FROM (SELECT DISTINCT digest FROM sums)
  UNION ALL
  SELECT digest, n, place, CAST(floor(CAST(place + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST((n >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT digest, place, (k * {FACTOR} + 1) % 18446744073709551616 AS n FROM jumps WHERE place < 40)),
ends AS (SELECT digest, max(stood) AS stood, max(place) AS place FROM jumps GROUP BY digest)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(stood AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY stood ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, CAST(CASE WHEN place = 40 THEN 40 ELSE stood END AS INTEGER) AS grown_shard
FROM sums JOIN ends USING (digest)
"""

"""Chat formatting: logged conversations that are prefixes of longer ones go, the others are rendered.

A service that logs the whole conversation after every turn leaves one snapshot per turn. Each conversation gets a
rolling hash of its first k turns for every k. One whose whole hash is the hash of another's shorter prefix is a
snapshot. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import bounded, table

#: Ids of maximal conversations that are broadcast at most, a long each.
MOST_KEPT = 500_000


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, h1, h2): for each conversation the 128-bit hash of its first k turns, for every k up to n.

    A turn's own hash covers its rank, role and text, with nulls apart from empty text; a prefix's hash is the XOR
    of its turns', which their ranks keep in order. Only hashes pass the shuffle. Turns are ranked by turn, then
    role, then the text's hash, nulls first; repeated rows are turns of their own. Rows whose conv_id is null are left out.
    """
    own = turns.where("conv_id is not null").select("conv_id", "turn", "role", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("t"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "t")
    ranked = own.select("conv_id", "turn", "role", "t", F.row_number().over(order).alias("k"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select(
        "conv_id",
        "k",
        F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
        F.bit_xor(F.xxhash64("k", "t")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("t", "k", F.lit(1))).over(so_far).alias("h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the conversations that are a proper prefix of no other, one for each set of equal
    ones (that with the least conv_id), and how many those are.
    """
    hashes = turn_hashes(turns)
    whole = hashes.where("k = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = hashes.where("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def rendered(turn: Column) -> Column:
    """A turn as a template writes it; a null role or text is empty, and the template's own marks in a text are broken up."""
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), clean(turn["role"]), F.lit("\n"), clean(turn["text"]), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, chat): every maximal conversation, rendered turn after turn.

    turns has conv_id, turn, role and text; other columns are not used. An empty table gives an empty result. A
    conversation's text is one row, so that it must fit in memory; nothing else gathers rows of a conversation.
    Snapshots go before texts are gathered: where the conversations that stay are few enough to be broadcast their
    texts never reach the shuffle, else they end at the join with the ids that stay, in the shuffle that gathers.
    """
    kept = table(maximal(turns), "maximal")
    rows = turns.where("conv_id is not null").join(bounded(kept.select("conv_id"), MOST_KEPT), "conv_id", "left_semi")
    rows = rows.select("conv_id", "turn", "role", "text", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "t", "text"))).alias("turns"))
    chat = F.array_join(F.transform("turns", rendered), "")
    return chats.join(kept, "conv_id").select("conv_id", "n_turns", "copies", chat.alias("chat"))


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(role := role, text := text) ORDER BY k) AS turns,
    string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n, turns, count(*) AS copies, any_value(chat) AS chat FROM c GROUP BY n, turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM u))
SELECT conv_id, n AS n_turns, copies, chat FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = u.turns)
"""

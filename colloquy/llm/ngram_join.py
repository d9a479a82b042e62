"""All pairs of texts whose sets of word five-grams have a Jaccard similarity of at least 0.8, as classes and link counts.

MinHash bands bring texts together; candidate pairs are compared hash by hash and dropped as soon as the posterior
probability of reaching the threshold is below a tolerance; what remains is verified on the whole sets. Pairs are
never rows: each meeting of two blocks of texts happens inside one call, which returns counts and a spanning
forest. So a bucket or group of any size is dealt to many tasks, and no more rows are made than texts times blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import bounded, free, lean, release, table
from .words import mix, shingle_sets, word_hashes

THRESHOLD, SIZE = 0.8, 5
#: A pair at the threshold shares no band with a chance of (1 - 0.8 ** 5) ** 25, about 5 in 100,000.
BANDS, ROWS = 25, 5
#: Further hashes for the comparison, looked at STEP by STEP.
COMPARED, STEP = 64, 16
TOLERANCE = 1e-4
#: Texts in a block; a call holds two blocks.
BLOCK = 512


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64), 77) | np.uint64(1)


_M = _multipliers(BANDS * ROWS + COMPARED)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the fewest matches among the hashes so far with which a pair stays.

    With a uniform prior, m matches of n make the similarity Beta(m + 1, n - m + 1); its chance of reaching the
    threshold is the chance that at most m of n + 1 independent draws succeed at the threshold.
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        term = [math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)]
        out.append(next(m for m in range(n + 1) if sum(term[: m + 1]) >= tolerance))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each set, of which none is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_M)), np.uint64)
    for k, m in enumerate(_M):
        out[:, k] = np.minimum.reduceat(flat * m, starts)
    return out


@lean
def _sign(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, same, text) to (doc_id, same, h1, h2, n, bands, rest); rows without words have a null h1."""
    for whole in batches:
        at, size = 0, whole.num_rows
        while at < size:
            batch = whole.slice(at, 512)
            at += 512
            texts = batch.column(2).to_pylist()
            sets = list(shingle_sets(*word_hashes(texts), SIZE))
            full = [i for i, s in enumerate(sets) if len(s)]
            n = len(texts)
            h = np.zeros((n, 2), np.uint64)
            bands: list = [None] * n
            rest: list = [None] * n
            lengths = np.array([len(s) for s in sets], np.int64)
            for part in _parts(full, lengths):
                given = [sets[i] for i in part]
                minima = signatures(given)
                starts = np.cumsum([0, *map(len, given[:-1])])
                flat = np.concatenate(given)
                h[part, 0] = np.add.reduceat(mix(flat, 1), starts)
                h[part, 1] = np.add.reduceat(mix(flat, 2), starts)
                keys = np.zeros((len(part), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys ^ minima[:, r : BANDS * ROWS : ROWS], r)
                low = (minima[:, BANDS * ROWS :] >> np.uint64(40)).astype(np.uint16)
                for i, k, x in zip(part, keys.view(np.int64).tolist(), low):
                    bands[i], rest[i] = k, x.tobytes()
            h1 = pa.array(h[:, 0].view(np.int64), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), h1, pa.array(h[:, 1].view(np.int64)), pa.array(lengths), pa.array(bands, pa.list_(pa.int64())), pa.array(rest, pa.binary())], names=names
            )


def _parts(full: list[int], lengths: np.ndarray, most: int = 1 << 20) -> Iterator[list[int]]:
    part, held = [], 0
    for i in full:
        part.append(i)
        held += lengths[i]
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


SIGNED = "doc_id long, same long, h1 long, h2 long, n long, bands array<long>, rest binary"


def blocks_meet(rows: DataFrame, group: list[str], size: str, key: str) -> DataFrame:
    """rows plus tile and side: rows of a group fall into blocks of about BLOCK rows by a hash of key, and each block
    meets each other block of its group, and itself, in one tile. A row is in as many tiles as its group has blocks.
    """
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(key, F.lit(3)), n).cast("int")
    at = rows.withColumn("_n", n).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    tile = F.struct(F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    return at.withColumn("tile", F.xxhash64(*group, tile)).withColumn("alone", F.least("_own", "_other") == F.greatest("_own", "_other")).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_n", "_own", "_other")


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows of whole tiles at once, of a partition that is sorted by tile: many small ones, or one large one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(batch.schema.get_field_index("tile")).to_numpy()
        cut = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on in the next batch
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
        elif held and held[-1].column(batch.schema.get_field_index("tile"))[-1].as_py() != tile[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pair_indices(tile: np.ndarray, alone: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that meet. Tiles of two rows come all together; a larger one by itself."""
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    ends = np.r_[starts[1:], len(tile)]
    two = starts[(ends - starts == 2)]
    if len(two):
        ok = alone[two] | (side[two] != side[two + 1])
        yield two[ok], two[ok] + 1
    for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
        if alone[s]:
            a, b = np.triu_indices(e - s, 1)
            yield a + s, b + s
        else:
            left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
            yield np.repeat(left, len(right)), np.tile(right, len(left))


def forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, into: list[tuple[int, int]]) -> None:
    """Adds the edges of a spanning forest of the pairs (ids[a], ids[b])."""
    if len(a) == 1:
        into.append((int(ids[a[0]]), int(ids[b[0]])))
        return
    parent: dict[int, int] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        while (p := parent.get(y, y)) != y:
            parent[y] = parent.get(p, p)
            y = p
        if x != y:
            parent[y] = x
            into.append((int(ids[x]), int(ids[y])))


@lean
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, alone, side, vid, rest) to a spanning forest, for each tile, of the pairs that the comparison keeps."""
    least = least_matches()
    for t in by_tile(batches):
        tile, alone, side, ids = (t.column(c).to_numpy() for c in ("tile", "alone", "side", "vid"))
        rest = np.frombuffer(b"".join(t.column("rest").to_pylist()), np.uint16).reshape(len(tile), COMPARED)
        edges: list[tuple[int, int]] = []
        for a, b in pair_indices(tile, alone, side):
            matches = np.zeros(len(a), np.int64)
            for k, need in enumerate(least):
                cols = slice(k * STEP, (k + 1) * STEP)
                matches += (rest[a, cols] == rest[b, cols]).sum(1)
                stay = matches >= need
                if not stay.all():
                    a, b, matches = a[stay], b[stay], matches[stay]
                if not len(a):
                    break
            if len(a) and tile[a[0]] != tile[a[-1]]:  # tiles of two
                edges += zip(ids[a].tolist(), ids[b].tolist())
            elif len(a):
                forest(a, b, ids, edges)
        yield pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets in left with all in right (indices), by products of incidence matrices."""
    used = np.union1d(left, right)
    flat = np.concatenate([sets[i] for i in used.tolist()])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()])
    _, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1  # what only one set has adds nothing
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, owner = column[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(shared.sum())
    out = np.zeros((len(left), len(right)), np.float32)
    rows_l, rows_r = np.searchsorted(used, left), np.searchsorted(used, right)
    for c in range(0, total, columns):
        lo, hi = np.searchsorted(column, [c, c + columns])
        m = np.zeros((len(used), min(columns, total - c)), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        out += m[rows_l] @ m[rows_r].T
    return out


@lean
def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (tile, alone, side, vid, weight, shingles, band, bands) to (kind, a, b): the links of a text, as the sum of
    the weights of those that the tile links to it (kind 0), and a spanning forest of the links (kind 1).

    In a tile of a band, pairs that share an earlier band are passed over, so that each pair is met once.
    """
    for t in by_tile(batches):
        tile, alone, side, ids, weight, band = (t.column(c).to_numpy() for c in ("tile", "alone", "side", "vid", "weight", "band"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        keys = np.array([x or [0] * BANDS for x in t.column("bands").to_pylist()], np.int64) if (band > 0).any() else None
        links = np.zeros(len(tile), np.int64)
        edges: list[tuple[int, int]] = []
        for a, b in pair_indices(tile, alone, side):
            if keys is not None:
                before = ((keys[a] == keys[b]) & (np.arange(BANDS) < band[a][:, None])).any(1)
                a, b = a[~before], b[~before]
            if not len(a):
                continue
            if tile[a[0]] != tile[a[-1]] or len(a) == 1:
                meet = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())])
            else:
                left, right = np.unique(a), np.unique(b)
                meet = common(sets, left, right)[np.searchsorted(left, a), np.searchsorted(right, b)]
            linked = meet >= threshold * (size[a] + size[b] - meet) - 1e-9
            a, b = a[linked], b[linked]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            if len(a) and tile[a[0]] != tile[a[-1]]:
                edges += zip(ids[a].tolist(), ids[b].tolist())
            elif len(a):
                forest(a, b, ids, edges)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array([0] * len(some) + [1] * len(edges), pa.int32()), "a": pa.array([*ids[some].tolist(), *(e[0] for e in edges)], pa.int64()), "b": pa.array([*links[some].tolist(), *(e[1] for e in edges)], pa.int64())}
        )


@lean
def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vid, text) to the same with the text's set in its place."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            sets = shingle_sets(*word_hashes(batch.column(1).to_pylist()), SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["vid", "shingles"])


#: Texts whose names are broadcast at most, three longs each; where more are to be read again, texts are shuffled to them.
MOST_NAMES = 500_000


def similar(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_same): one row for each row of docs (doc_id LONG, text STRING, others unused).

    Two texts are linked if the Jaccard similarity of their sets of five-word runs is at least 0.8 (a text of one to
    four words has one run, of all its words). class_id is the least doc_id that links reach, one after another;
    n_links is the number of different texts that the row's text is linked to, equal ones aside; n_same is the
    number of rows with the row's own text. Texts without a word (null, empty or only signs) link to nothing, not
    even to their equals: class_id is the row's own doc_id and n_same 1. A row whose doc_id is null takes part
    through its text; class_id is null only if no row of its class has an id. Repeated rows count as copies.

    Texts with equal sets are one vertex, so copies meet nowhere. Vertices are told apart by 64 of 128 bits of a
    hash of their set. The comparison misses a linked pair with a chance of about 1 in 10,000 at a similarity of
    exactly 0.8 and far less above. What is left is verified on whole sets: all pairs of a component of candidates or,
    where that is less work (long chains of candidates), the pairs that share a bucket.
    """
    return _classified(docs, threshold).drop("same", "component")


def _classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """What `similar` returns, with each row's hash of its text and its component, which tells classes apart (null without a word)."""
    names = [x.split()[0] for x in SIGNED.replace("array<long>", "array").split(", ")]
    signed = table(docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(lambda it: _sign(it, names), SIGNED), "signed")
    texts = signed.where("h1 is not null").groupBy("h1", "h2", "n", "same").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("rest").alias("rest"))
    sets = table(
        texts.groupBy("h1", "h2", "n").agg(F.min("first").alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands"), F.first("rest").alias("rest"), F.min_by("same", F.struct(F.col("first").isNull(), "first")).alias("same")).withColumn("vid", F.xxhash64("h1", "h2", "n")).drop("h1", "h2"),
        "sets",
    )
    # buckets that more than one set falls into
    keyed = sets.select("vid", F.posexplode("bands").alias("band", "key"))
    counted = keyed.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = keyed.join(counted, ["band", "key"])
    tiles = blocks_meet(met, ["band", "key"], "members", "vid").select("tile", "alone", "side", "vid").join(sets.select("vid", "rest"), "vid")
    kept = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_candidates, "a long, b long")
    candidates = components(kept)
    groups = table(candidates.select(F.col("node").alias("vid"), "component"), "groups")
    release(candidates)
    sized = groups.groupBy("component").agg(F.count("*").alias("members"))
    # whole sets of what is left, from one text of each
    left = table(groups.join(sized, "component").join(sets.select("vid", "weight", "first", "same"), "vid"), "left")
    named = bounded(left.select("vid", F.col("first").alias("_first"), F.col("same").alias("_same")), MOST_NAMES)
    bodies = docs.select("doc_id", F.xxhash64("text").alias("same"), "text").join(named, (F.col("same") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    bodies = bodies.select("vid", "text").dropDuplicates(["vid"])
    shingled = bodies.mapInArrow(_shingle, "vid long, shingles binary").join(left.select("vid", "component", "weight", "members"), "vid")
    names = ["tile", "alone", "side", "vid", "weight", "shingles", "band", "bands"]
    all_pairs = lambda rows: blocks_meet(rows, ["component"], "members", "vid").withColumn("band", F.lit(-1)).withColumn("bands", F.lit(None).cast("array<long>")).select(names)
    chains = table(_chains(met, left), "chains")
    if chains.isEmpty():
        tiles = all_pairs(shingled)
    else:
        few = bounded(chains)
        shingled = table(shingled, "shingled")
        by_band = shingled.drop("members").join(few, "component", "left_semi").join(met, "vid").join(sets.select("vid", "bands"), "vid")
        tiles = all_pairs(shingled.join(few, "component", "left_anti")).unionByName(blocks_meet(by_band, ["band", "key"], "members", "vid").select(names))
    found = table(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: _verify(it, threshold), "kind int, a long, b long"), "links")
    release(groups, left, chains, shingled)
    links = found.where("kind = 0").groupBy(F.col("a").alias("vid")).agg(F.sum("b").alias("links"))
    linked = components(found.where("kind = 1").select("a", "b"))
    joined = linked.select(F.col("node").alias("vid"), "component")
    placed = sets.select("vid", "weight", "first").join(joined, "vid", "left").join(links, "vid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "vid"))
    heads = placed.groupBy("component").agg(F.min("first").alias("class_id"))
    classes = table(placed.join(heads, "component").select("vid", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "classes")
    release(found, linked, sets)
    same = texts.select(F.xxhash64("h1", "h2", "n").alias("vid"), F.col("same"), F.col("rows").alias("n_same")).join(classes, "vid")
    whole = signed.select("doc_id", F.xxhash64("h1", "h2", "n").alias("vid"), "same", F.col("h1").isNull().alias("_bare"))
    out = whole.join(same, ["vid", "same"], "left")
    return out.select("doc_id", F.when(F.col("_bare"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_same", F.lit(1)).alias("n_same"), "same", "component")


def _chains(met: DataFrame, left: DataFrame) -> DataFrame:
    """(component) of the components of candidates in which fewer blocks meet by buckets than if all members met each other."""
    large = left.where(F.col("members") > BLOCK).select("vid", "component", "members")
    buckets = met.select("vid", F.ceil(F.col("members") / BLOCK).alias("tiles")).join(large, "vid").groupBy("component").agg(F.sum("tiles").alias("tiles"), F.first("members").alias("members"))
    return buckets.where(F.col("tiles") < F.col("members") * F.ceil(F.col("members") / BLOCK)).select("component")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each class of `similar` is kept: that with the least doc_id.

    Where a doc_id repeats with texts of several classes, one of its texts stays in each class that it heads, that of
    the least hash; of rows with equal doc_id and text one stays. A text without a word is a class of its own with its
    doc_id. Rows whose doc_id is null all stay, as nothing names them. What goes is looked up by its id and the hash of
    its text; where that is little it is broadcast, so that texts are not shuffled.
    """
    same, n = free(docs, "same", "n")
    pairs = _classified(docs).where("doc_id is not null").groupBy("doc_id", F.col("same").alias(same))
    pairs = table(pairs.agg(F.count("*").alias(n), F.first("class_id").alias("class_id"), F.first("component").alias("component")), "pairs")
    heads = pairs.where("doc_id = class_id").groupBy("doc_id", F.col("component").isNull(), F.coalesce("component", same)).agg(F.min(same).alias(same)).select("doc_id", same)
    gone = table(pairs.select("doc_id", same).join(heads, ["doc_id", same], "left_anti"), "gone")
    out = docs.withColumn(same, F.xxhash64("text")).join(bounded(gone, MOST_NAMES), ["doc_id", same], "left_anti")
    often = table(pairs.where(F.col(n) > 1).select("doc_id", same), "often")
    if not often.isEmpty():
        few = bounded(often, MOST_NAMES)
        out = out.join(few, ["doc_id", same], "left_anti").unionByName(out.join(few, ["doc_id", same], "left_semi").dropDuplicates(["doc_id", same]))
    return out.select(docs.columns)


def op6_bayes_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_same")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
t AS (SELECT text, min(doc_id) AS first, count(*) AS n_same, any_value(words) AS words FROM w WHERE len(words) > 0 GROUP BY text),
s AS (SELECT first, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS g FROM t),
n AS (SELECT first, count(*) AS n FROM s GROUP BY first),
m AS (SELECT a.first AS a, b.first AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.first <> b.first GROUP BY 1, 2),
e AS (SELECT a, b FROM m JOIN n x ON x.first = a JOIN n y ON y.first = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT first, first FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a AS first, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a AS first, count(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(t.n_same, 1) AS n_same
FROM w LEFT JOIN t ON t.text = w.text LEFT JOIN k ON k.first = t.first LEFT JOIN l ON l.first = t.first
"""

"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

Every byte of a text is given the number of the token that holds it, once for each tokenizer. Where the pair of owners
changes, the next overlap of two tokens begins; where both change at once, both tokenizers cut, and a group ends.

Each text is encoded once. What depends on the text alone is told then, with its id pairs, in a table; how often a pair comes
over all texts is summed from that table and brought back to it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .scratch import free, lean, look_up, plus, table
from .token_counts import SPACE, PieceModel

_OTHER = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A place before a space or line end that neither tokenizer's tokens cross, as what comes before is no white space.
CUT = re.compile(f"(?<=[^ \n{_OTHER}])(?=[ \n])")
#: White space that is too long for the fast encoder's pattern.
LONG_WHITE = re.compile(f"[ \n{_OTHER}]{{2000}}")
#: Characters of a text, and of several texts together, that are looked at at a time, about.
BLOCK = 1 << 18
#: Rows that a worker hands on at a time.
ROWS = 1000
#: Id pairs whose counts are broadcast at most, of 17 bytes each; more are joined.
MOST_PAIRS = 4_000_000


class ByteModel:
    """A byte-level BPE in a tokenizer file, special tokens taken as plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        self._plain.no_truncation()
        self._plain.no_padding()
        said = json.loads(self._plain.to_str())
        cut, model = said["pre_tokenizer"], said["model"]
        if said["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("not a byte-level tokenizer of the kind that keeps every byte and cuts before white space")
        of = {letter: byte for byte, letter in byte_letters().items()}
        ranks = {bytes(of[letter] for letter in token): i for token, i in model["vocab"].items()}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        in_order = len(ranks) == 256 + len(merges) and all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # what ByteLevel cuts by
        self._fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._plain.encode(t, add_special_tokens=False).ids if self._fast is None or LONG_WHITE.search(t) else self._fast.encode_ordinary(t) for t in texts]


class Pieces(PieceModel):
    """A sentencepiece model that gives ids; the space that it puts before a text is left to the caller."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.prefix:
            raise ValueError("this model puts no space before a text")
        pieces = [self._processor.id_to_piece(i) for i in range(self._processor.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self._processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._processor.encode(texts, num_threads=1)


def blocks(text: str) -> Iterator[str]:
    """The text in portions that end where both tokenizers cut; a stretch without such a place is one portion."""
    start = 0
    while len(text) - start > BLOCK and (cut := CUT.search(text, start + BLOCK)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that holds it."""
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From byte lengths of A's and B's tokens over the same bytes: the A tokens and the B tokens of all overlaps, in order,
    and whether a group begins with an overlap, that is whether both owners change."""
    own_a, own_b = owners(a), owners(b)
    change_a, change_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    starts = np.flatnonzero(np.concatenate([[True], change_a | change_b]))
    return own_a[starts], own_b[starts], np.concatenate([[True], change_a & change_b])[starts]


class Portion:
    """What the alignment of one portion tells: A's tokens, B's tokens, groups and links; the links' id pairs, the groups as text and their bytes."""

    def __init__(self, figures: list[int], pairs: np.ndarray, told: str, ids: tuple[list[int], list[int]], cuts: tuple[list[int], list[int], list[int]]):
        self.figures, self.pairs, self.told, self._ids, self._cuts = figures, pairs, told, ids, cuts

    def groups(self, start: int) -> list[dict]:
        """The groups with their byte offsets, the first from start."""
        (a, b), (at_a, at_b, ends) = self._ids, self._cuts
        edges = [0, *ends]
        return [
            {"start": start + lo, "end": start + hi, "a": a[i:j], "b": b[k:m]}
            for lo, hi, i, j, k, m in zip(edges, ends, at_a, [*at_a[1:], len(a)], at_b, [*at_b[1:], len(b)])
        ]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteModel(a_path), Pieces(b_path)
        self._sizes = [np.array([len(x) for x in m.bytes], np.int64) for m in (self.a, self.b)]
        #: A's and then B's ids as text, with what stands behind them: a comma, a bar after A's last of a group, a semicolon after B's last.
        self._words = [f"{i}{after}" for m in (self.a, self.b) for i in range(len(m.bytes)) for after in ",|;"]
        self._first_b = len(self.a.bytes)

    def align(self, texts: list[str]) -> list[Portion | None]:
        """The portions' alignments, all found in one array; None where the tokens' bytes are not the text's."""
        ids = self.a.encode(texts), self.b.encode(texts)
        raw = [t.encode() for t in texts]
        good = [k for k in range(len(texts)) if all(b"".join(map(m.bytes.__getitem__, own[k])) == raw[k] for m, own in zip((self.a, self.b), ids))]
        out: list[Portion | None] = [None] * len(texts)
        if not good:
            return out
        ids = tuple([own[k] for k in good] for own in ids)
        flat = [np.fromiter(itertools.chain.from_iterable(own), np.int64) for own in ids]
        sizes = [size[own] for size, own in zip(self._sizes, flat)]
        link_a, link_b, begins = overlaps(*sizes)  # a portion's end is a cut of both, so that no link goes beyond it
        pairs = flat[0][link_a] << 32 | flat[1][link_b]
        heads = np.flatnonzero(begins)
        at = [link_a[heads], link_b[heads]]  # the tokens that groups begin with
        words = self._told(flat, at)
        starts = [np.cumsum([0, *map(len, own)]) for own in ids]
        first_link = np.searchsorted(link_a, starts[0])
        first_group = np.searchsorted(at[0], starts[0])
        ends = np.cumsum(np.add.reduceat(sizes[0], at[0]))
        for n, k in enumerate(good):
            (a, b), g, h = (own[n] for own in ids), first_group[n], first_group[n + 1]
            told = "".join(map(self._words.__getitem__, words[starts[0][n] + starts[1][n] : starts[0][n + 1] + starts[1][n + 1]].tolist()))[:-1]
            before = ends[g - 1] if g else 0
            cuts = (at[0][g:h] - starts[0][n]).tolist(), (at[1][g:h] - starts[1][n]).tolist(), (ends[g:h] - before).tolist()
            out[k] = Portion([len(a), len(b), int(h - g), int(first_link[n + 1] - first_link[n])], pairs[first_link[n] : first_link[n + 1]], told, (a, b), cuts)
        return out

    def _told(self, flat: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
        """Numbers of words, A's tokens of a group and then B's, group after group."""
        n = [len(x) for x in flat]
        word = np.empty(sum(n), np.int64)
        sizes = [np.diff(np.append(start, total)) for start, total in zip(at, n)]
        before = [np.cumsum(x) - x for x in sizes]
        for side in (0, 1):
            # in the whole a token comes after all of its own side before it, and the other side's of its group (for B) or of those before
            shift = before[1] if side == 0 else before[0] + sizes[0]
            where = np.arange(n[side]) + np.repeat(shift, sizes[side])
            last = np.zeros(n[side], np.int64)
            last[np.cumsum(sizes[side]) - 1] = side + 1
            word[where] = (flat[side] + (self._first_b if side else 0)) * 3 + last
        return word


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's own, kept from task to task."""
    return Aligner(a_path, b_path)


class _Row:
    """A text's figures, as its portions come."""

    def __init__(self, want: bool):
        self.figures, self.sha, self.pairs, self.sound = np.zeros(4, np.int64), None, [], True
        self.groups: list[dict] | None = [] if want else None

    def add(self, portion: Portion | None) -> None:
        if portion is None:
            self.sound = False
        if not self.sound:
            return
        self.figures += portion.figures
        if self.sha is None:
            self.sha = hashlib.sha256(portion.told.encode())
        else:
            self.sha.update(f";{portion.told}".encode())
        names, times = np.unique(portion.pairs, return_counts=True)
        self.pairs.append((names, times))
        if self.groups is not None:
            self.groups += portion.groups(self.groups[-1]["end"] if self.groups else 0)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The text's different id pairs and how many links have each."""
        if len(self.pairs) == 1:
            return self.pairs[0]
        names, which = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        times = np.zeros(len(names), np.int64)
        np.add.at(times, which, np.concatenate([t for _, t in self.pairs]))
        return names, times


_NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int64)


def read(models: Aligner, texts: Iterable[str | None], want: bool = False) -> list[_Row | None]:
    """Each text's figures, None for one without tokens: null, empty, or tokens whose bytes are not its own."""
    rows: list[_Row | None] = []
    held: list[tuple[_Row, str]] = []
    chars = 0

    def settle() -> None:
        for (row, _), portion in zip(held, models.align([t for _, t in held]) if held else []):
            row.add(portion)
        held.clear()

    for text in texts:
        rows.append(_Row(want) if text else None)
        for block in blocks(f" {text}") if text else ():
            held.append((rows[-1], block))
            chars += len(block)
            if chars > BLOCK:
                settle()
                chars = 0
    settle()
    return [row if row and row.sound else None for row in rows]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_GROUP = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
_GROUP_DDL = "array<struct<start: long, end: long, a: array<long>, b: array<long>>>"


def _encoded(docs: DataFrame, own: list[str], pairs: str, times: str, a_path: str, b_path: str, want: tuple[str, ...]) -> DataFrame:
    """The columns own of docs plus n_a, n_b, n_groups, n_links, groups_sha256, the different id pairs with their times, and groups where wanted."""
    schema = plus(docs.select(own), "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + (f", groups {_GROUP_DDL}" if "groups" in want else "") + f", {pairs} array<long>, {times} array<int>")
    given = docs.select(*own, docs["text"].alias(free(docs, "whole")[0]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = aligner(a_path, b_path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows = read(models, (batch.column(batch.num_columns - 1)[k].as_py() for k in range(batch.num_rows)), "groups" in want)
                figures = np.array([row.figures if row else [0] * 4 for row in rows], np.int64)
                links = [row.links() if row else _NOTHING for row in rows]
                edges = pa.array(np.cumsum([0, *(len(p) for p, _ in links)]), pa.int32())
                out = [*batch.columns[:-1], *(pa.array(figures[:, k]) for k in range(4)), pa.array([row.sha.hexdigest() if row else "" for row in rows], pa.string())]
                if "groups" in want:
                    out.append(pa.array([row.groups if row else [] for row in rows], pa.list_(_GROUP)))
                out.append(pa.ListArray.from_arrays(edges, pa.array(np.concatenate([p for p, _ in links]))))
                out.append(pa.ListArray.from_arrays(edges, pa.array(np.concatenate([t for _, t in links]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return given.mapInArrow(run, schema)


def pair_counts(encoded: DataFrame, pairs: str = "pairs", times: str = "times") -> DataFrame:
    """(pair, n, best): for each pair of ids that overlap anywhere how many overlaps there are, and whether no other A id has more with this B id.

    A pair is A's id times 2**32 plus B's. A B id's pairs, one for each A id at most, meet in one task.
    """
    each = encoded.select(F.explode(F.arrays_zip(F.col(pairs).alias("p"), F.col(times).alias("t"))).alias("x")).select("x.p", "x.t")
    counted = each.groupBy(F.col("p").alias("pair")).agg(F.sum("t").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def align(docs: DataFrame, a_path: str, b_path: str, want: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs but text, plus n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, replacing columns of these names.

    Each text, with one space before it, is encoded by the byte-level BPE of the tokenizer file at a_path (A) and the
    sentencepiece model at b_path (B), special tokens' strings taken as plain text. A null or empty text, or one whose
    tokens' bytes are not its own (one that holds U+2581, say), has no tokens: zeros, and '' for groups_sha256. Groups
    lie between byte offsets at which tokens of both end; links are overlaps of an A token with a B token; n_best are
    those whose id pair is, over all docs, the most frequent of its B id (ties included); count_sum adds up their
    pairs' counts over all docs. Repeated rows count each. With "groups" in want a column groups has the groups
    themselves, byte offsets and ids; with "text" the text stays.

    Counts of up to MOST_PAIRS pairs are broadcast; more are joined with the pairs of each text, the frequent ones apart from
    the others. Beside a text itself and its different pairs, memory is bounded by BLOCK, but for a text without spaces.
    """
    own = [c for c in docs.drop(*_FIGURES, "groups_sha256", "groups").columns if c != "text" or "text" in want]
    pairs, times, row = free(docs.withColumns(dict.fromkeys(["pair", "n", "best"], F.lit(0))), "pairs", "times", "row")
    once = table(_encoded(docs, own, pairs, times, a_path, b_path, want).withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = table(pair_counts(once, pairs, times), "pairs")
    names = [*own, *_FIGURES, "groups_sha256", *(["groups"] if "groups" in want else [])]
    if counts.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        each = once.select(row, F.explode(F.arrays_zip(F.col(pairs).alias("p"), F.col(times).alias("t"))).alias("x")).select(row, F.col("x.p").alias("pair"), "x.t")
        sums = look_up(each, counts, "pair", "n").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("t"))).alias("n_best"), F.sum(F.col("n") * F.col("t")).alias("count_sum"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return once.join(sums, row, "left").select([zero(c) if c in ("n_best", "count_sum") else c for c in names])
    got = counts.toArrow()
    columns = [got[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")]
    order = np.argsort(columns[0])
    sent = docs.sparkSession.sparkContext.broadcast(tuple(c[order] for c in columns))
    schema = plus(once.drop(pairs, times, row), "n_best long, count_sum long")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted, best = sent.value
        for batch in batches:
            linked, often = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            of = np.repeat(np.arange(batch.num_rows), np.diff(linked.offsets.to_numpy()))
            at, t = np.searchsorted(known, linked.flatten().to_numpy()), often.flatten().to_numpy().astype(np.int64)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], of, t * best[at])
            np.add.at(sums[1], of, t * counted[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sums[0]), pa.array(sums[1])], names=schema.names)

    return once.drop(row).mapInArrow(run, schema).select(names)


def op12_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

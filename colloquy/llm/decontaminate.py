"""Benchmark passages in documents, by edit distance over words.

Windows of an item's size slide over each document. The CGK embedding walks over a window with random bits: at step
j it puts out the word under it and moves on if the bit of that word at step j says so. Windows at a small edit
distance have embeddings at a small Hamming distance, so a hash of a few sampled steps agrees with some chance; with
several walks, all but a few leaks agree once. What agrees is verified by the exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import lean, plus
from .words import mix, word_hashes

#: Edits per word of an item that a leak may have, rounded down.
EDITS = 0.15
SAMPLED = 5
RECALL = 0.99
LEAST_WALKS, MOST_WALKS = 4, 24
TRIALS = 2000
WIDEST = 16
#: Longer items are tried by so many of their words: they are found more easily.
LONG = 128
#: Items with fewer words have no edits that count; they are looked for word by word, without walks.
LEAST_WORDS = 5
#: Bytes of an index that is broadcast at a time, at most, if no single item needs more.
INDEX_BYTES = 96 << 20
#: What one entry takes, of which each word of an item has MOST_WALKS at most, and what a word itself takes.
ENTRY_BYTES, WORD_BYTES = 16, 8
#: Windows that walk at a time, and agreements that are written out at a time.
AT_ONCE = 1 << 20


def window_of(words: int) -> tuple[int, int]:
    """(window, stride) for items of so many words: each occurrence holds whole windows that begin at every stride.

    A window has at least a quarter of the item's words as long as that is at most WIDEST; wider ones would hardly
    ever be free of edits, and need many walks: WIDEST is for items of two such windows and more.
    """
    most = WIDEST if words >= 2 * WIDEST else WIDEST // 2
    window = min(most, 1 << (max(1, (2 * words + 2) // 3).bit_length() - 1))
    return window, max(1, window // 2)


def edits_of(words: int) -> int:
    return int(words * EDITS)


def sampled_steps(window: int, walk: int) -> np.ndarray:
    """The steps of a walk whose words make the hash, drawn among twice the window: about where the walk ends."""
    draws = mix(np.arange(64, dtype=np.uint64), 1000 + 31 * walk + window)
    steps = list(dict.fromkeys((draws % np.uint64(max(1, 2 * window - 1))).tolist()))
    return np.sort(np.array(steps[: min(SAMPLED, len(steps))], np.int64))


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, walk: int) -> np.ndarray:
    """A hash of the sampled steps of the embedding of the windows that begin at starts; a walk that leaves its window stays at the end.

    ends are where each window's text ends, in words. All windows walk at once, one step at a time.
    """
    steps = sampled_steps(window, walk)
    end = np.minimum(starts + window, ends)
    padded = np.append(words, np.uint64(0))
    bits = [mix(padded, 2 * walk + 5), mix(padded, 2 * walk + 6)] if 2 * window > 64 else [mix(padded, 2 * walk + 5)]
    at = starts.copy()
    key = np.full(len(starts), walk * 64 + window.bit_length(), np.uint64)
    take = set(steps.tolist())
    for j in range(int(steps[-1]) + 1):
        here = np.minimum(at, end)
        inside = here < end
        if j in take:
            key = mix(key ^ np.where(inside, padded[here], np.uint64(0)), j)
        b = bits[(j >> 6) % len(bits)]
        at += ((b[here] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64) & inside
    return key


def edit_distance_within(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance between item and a stretch of text, where the first such stretch ends), bit-parallel."""
    n = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for k, w in enumerate(text):
        eq = where.get(w, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        h_up = (down | ~(d0 | up)) & full
        h_down = up & d0
        score += (1 if h_up & top else 0) - (1 if h_down & top else 0)
        h_up = (h_up << 1) & full  # a stretch may begin anywhere, so the first row costs nothing
        h_down = (h_down << 1) & full
        up = (h_down | ~(d0 | h_up)) & full
        down = h_up & d0
        if score < best:
            best, end = score, k + 1
    return best, end


@dataclass
class Index:
    """The items' windows of one size, over all walks."""

    window: int
    stride: int
    walks: int
    keys: np.ndarray  # sorted
    items: np.ndarray
    offsets: np.ndarray
    table: np.ndarray  # whether any key has these leading bits

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place) of windows that agree with an entry in some walk, each once, in this order.

        place is where the item would begin in its text. Windows and agreements are dealt with AT_ONCE at a time,
        so that a stretch which agrees with very many entries, as one repeated word does, is never written out whole.
        """
        n = np.diff(offsets)
        count = np.maximum(0, -(-(n - self.window + 1) // self.stride)).astype(np.int64)
        before = np.cumsum(np.r_[0, count])
        found = [np.empty((3, 0), np.int64)]
        held = 0
        for lo in range(0, int(before[-1]), AT_ONCE):
            nth = np.arange(lo, min(lo + AT_ONCE, int(before[-1])), dtype=np.int64)
            text = np.searchsorted(before, nth, "right") - 1
            starts, ends = offsets[text] + (nth - before[text]) * self.stride, offsets[text + 1]
            for walk in range(self.walks):
                key = embed(words, starts, ends, self.window, walk)
                some = np.flatnonzero(self.table[(key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
                first = np.searchsorted(self.keys, key[some])
                times = np.searchsorted(self.keys, key[some], "right") - first
                for part in _portions(times):
                    at, many = some[part], times[part]
                    entry = np.repeat(first[part] - np.cumsum(np.r_[0, many[:-1]]), many) + np.arange(int(many.sum()))
                    of = np.repeat(text[at], many)
                    place = np.repeat(starts[at], many) - self.offsets[entry] - offsets[of]
                    found.append(_distinct(np.stack([of, self.items[entry], place])))
                    held += found[-1].shape[1]
                    if held > 4 * AT_ONCE:
                        found = [_distinct(np.concatenate(found, 1))]
                        held = 0
        return tuple(_distinct(np.concatenate(found, 1)))


def _portions(times: np.ndarray) -> Iterator[slice]:
    """Slices of times that add up to AT_ONCE or less each, or are of length 1."""
    total, start = np.cumsum(times), 0
    while start < len(times):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + AT_ONCE, "right")))
        if total[end - 1] > done:
            yield slice(start, end)
        start = end


def _distinct(columns: np.ndarray) -> np.ndarray:
    """The different columns of an array of three rows, sorted."""
    columns = columns[:, np.lexsort(columns[::-1])]
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(0)
    return columns[:, new]


TABLE_BITS = 21


def found_after(items: list[np.ndarray], trials: int, walks: int, enough: float = 1.0, seed: int = 7) -> list[float]:
    """The shares of trials that have agreed in some window after 1, 2, ... walks, jointly; ends where `enough` have.

    The items, of one length, take turns. Each is edited at random places by as many substitutions, deletions and
    insertions as count, and stands between random words, at most a stride of them before it and a window after.
    """
    dice = np.random.default_rng(seed)
    size = len(items[0])
    window, stride = window_of(size)
    edits = edits_of(size)
    spots, kinds, news = dice.random((trials, edits)).tolist(), dice.integers(3, size=(trials, edits)).tolist(), dice.integers(1 << 62, size=(trials, edits)).tolist()
    texts, lengths = [], []
    for t in range(trials):
        text = items[t % len(items)].tolist()
        for spot, kind, new in zip(spots[t], kinds[t], news[t]):
            at = int(spot * len(text))
            text[at : at + 1] = [[new], [], [new, text[at]]][kind]
        text = [*dice.integers(1 << 62, size=dice.integers(stride)).tolist(), *text, *dice.integers(1 << 62, size=dice.integers(window + 1)).tolist()]
        texts += text
        lengths.append(len(text))

    def windows(n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(trial, start, end of the text) of all windows of texts with n words, one text after the other."""
        count = np.maximum(0, -(-(n - window + 1) // step))
        trial = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(trial)) - np.repeat(np.cumsum(count) - count, count)
        return trial, (np.cumsum(n) - n)[trial] + nth * step, np.cumsum(n)[trial]

    words, own = np.array(texts, np.uint64), np.concatenate([items[t % len(items)] for t in range(trials)])
    sides = [(words, *windows(np.array(lengths), stride)), (own, *windows(np.full(trials, size), 1))]
    open_ = np.ones(trials, bool)
    shares: list[float] = []
    for walk in range(walks):
        keys, trial = [], []
        for w, t, start, end in sides:
            left = open_[t]
            trial.append(t[left])
            keys.append(mix(embed(w, start[left], end[left], window, walk) ^ mix(t[left].astype(np.uint64))))
        open_[trial[0][np.isin(keys[0], keys[1])]] = False
        shares.append(1 - float(open_.mean()))
        if shares[-1] >= enough:
            break
    return shares


def walks_needed(items: list[np.ndarray], recall: float = RECALL) -> int:
    """Walks with which so many of the given items, all of one length and at the most edits that count, are found; by trial.

    Walks over one text are not independent, so it is their joint recall that is measured, and two standard errors
    are asked beyond it. This sets how much work is done, not what counts.
    """
    beyond = recall + 2 * math.sqrt(recall * (1 - recall) / TRIALS)
    return max(LEAST_WALKS, len(found_after(items, TRIALS, MOST_WALKS, beyond)))


def build(items: list[tuple[int, np.ndarray]]) -> list[Index]:
    """Indexes by window size; entries are all windows of every item, at each offset, over the walks that its length needs."""
    lengths: dict[int, list[np.ndarray]] = {}
    for _, words in items:
        if len(words) >= LEAST_WORDS:
            lengths.setdefault(min(len(words), LONG), []).append(words[:LONG])
    needed = {n: walks_needed(of) for n, of in lengths.items()}
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, words in items:
        if len(words) >= LEAST_WORDS:
            classes.setdefault(window_of(len(words))[0], []).append((k, words))
    out = []
    for window, members in sorted(classes.items()):
        keys, owner, offsets = [], [], []
        for k, words in members:
            own = np.arange(0, len(words) - window + 1, dtype=np.int64)
            for walk in range(needed[min(len(words), LONG)]):
                keys.append(embed(words, own, np.full(len(own), len(words)), window, walk))
                owner.append(np.full(len(own), k))
                offsets.append(own)
        walks = max(needed[min(len(words), LONG)] for _, words in members)
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        owners, places = np.concatenate(owner).astype(np.int32), np.concatenate(offsets).astype(np.int32)
        out.append(Index(window, max(1, window // 2), walks, flat[order], owners[order], places[order], table))
    return out


def phrase_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    key = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        key = mix(key ^ words[k : k + len(key)], 900 + k)
    return key


@dataclass
class Phrases:
    """Items of fewer than LEAST_WORDS words, by the hashes of their words."""

    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted keys, and whose they are

    @staticmethod
    def of(items: list[np.ndarray]) -> Phrases:
        short = {size: [k for k, w in enumerate(items) if len(w) == size] for size in range(1, LEAST_WORDS)}
        made = {}
        for size, members in short.items():
            if members:
                keys = np.concatenate([phrase_keys(items[k], size) for k in members])
                order = np.argsort(keys)
                made[size] = keys[order], np.array(members)[order]
        return Phrases(made)

    def find(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """As `_verify`: the first place of each phrase in each text."""
        for size, (keys, owner) in self.keys.items():
            own = phrase_keys(words, size)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == own)
            text = np.searchsorted(offsets, hit, "right") - 1
            whole = hit + size <= offsets[text + 1]
            hit, text = hit[whole], text[whole]
            pair = text * len(keys) + at[hit]
            _, first = np.unique(pair, return_index=True)
            for k in first.tolist():
                place = int(hit[k] - offsets[text[k]])
                yield int(text[k]), int(owner[at[hit[k]]]), 0, place, place + size


FOUND = "item_id long, edits long, n_words long, start_word long, end_word long"


def _verify(index: list[Index], items: list[np.ndarray], words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, word after the last) of the items that texts hold; the first best place of each."""
    n = np.diff(offsets)
    for ix in index:
        text, item, place = ix.hits(words, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for t, i, p in zip(text.tolist(), item.tolist(), place.tolist()):
            size = len(items[i])
            k = edits_of(size)
            lo, hi = max(0, p - 2 * k - 1), min(int(n[t]), p + size + 2 * k + 1)
            if (t, i) in done and hi <= done[t, i] or best.get((t, i), (1,))[0] == 0:
                continue
            done[t, i] = hi
            part = words[offsets[t] + lo : offsets[t] + hi].tolist()
            edits, end = edit_distance_within(items[i].tolist(), part)
            if edits > k or (t, i) in best and edits >= best[t, i][0]:
                continue
            while True:  # the place may have been met at its edge: look around it until that gains nothing
                a = lo + end - edit_distance_within(items[i].tolist()[::-1], part[:end][::-1])[1]
                b = lo + end
                lo, hi = max(0, a - 2 * k - 1), min(int(n[t]), b + 2 * k + 1)
                part = words[offsets[t] + lo : offsets[t] + hi].tolist()
                again, end = edit_distance_within(items[i].tolist(), part)
                if again >= edits:
                    break
                edits = again
            best[t, i] = (edits, a, b)
        for (t, i), (edits, a, b) in best.items():
            yield t, i, edits, a, b


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without text, one row for each document and item that it holds, plus item_id, edits, n_words, start_word, end_word.

    docs needs text; columns of the new names are replaced, others pass through. An item is held if some stretch of
    the text's words (lower case, signs aside) is within 15 edits for each 100 of the item's words, rounded down;
    the first stretch with the fewest is told. Null and empty texts hold nothing; items without a word, null or without
    an id are not looked for; equal items are each told; repeated rows of docs repeat their rows. Items of fewer than
    seven words have no edits that count; those of fewer than five are looked for word by word, without walks. The
    index misses at most about 1 in 100 stretches of any length that have all the edits that count, and none without edits.

    Items are collected in blocks of INDEX_BYTES, each indexed and broadcast by itself, so that what is sent is
    bounded (a single longer item apart); documents are never shuffled, but read once for each block.
    """
    parts = [_search(docs, block, False) for block in _item_blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, in docs' columns; `leaks` says what counts. Rows pass one block of items
    after the other, so that nothing is joined and a null or repeated doc_id changes nothing."""
    for block in _item_blocks(benchmark):
        docs = _search(docs, block, True)
    return docs


class Block:
    """Different items' words, and the ids of those that have them."""

    def __init__(self):
        self.items: list[np.ndarray] = []
        self.ids: list[list[int]] = []
        self._at: dict[bytes, int] = {}
        self._bytes = 0

    def add(self, item_id: int, words: np.ndarray) -> bool:
        """Whether there is room for them; the first item always fits."""
        key = words.tobytes()
        if key in self._at:
            self.ids[self._at[key]].append(item_id)
            return True
        more = len(words) * (MOST_WALKS * ENTRY_BYTES + WORD_BYTES)
        if self.items and self._bytes + more > INDEX_BYTES:
            return False
        self._at[key] = len(self.items)
        self.items.append(words)
        self.ids.append([item_id])
        self._bytes += more
        return True


def _item_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """At least one block, be it empty."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    block = Block()
    for r in rows.toLocalIterator():
        words = word_hashes([r["text"]])[0]
        if len(words) and not block.add(r["item_id"], words):
            yield block
            block = Block()
            block.add(r["item_id"], words)
    yield block


def _search(docs: DataFrame, block: Block, clean: bool) -> DataFrame:
    """What `leaks` returns for one block of items or, if clean, the rows of docs that hold none of them."""
    sent = docs.sparkSession.sparkContext.broadcast((build(list(enumerate(block.items))), Phrases.of(block.items), block.items, block.ids))
    keep = docs if clean else docs.drop(*(x.split()[0] for x in FOUND.split(", ")))
    schema = keep.schema if clean else plus(keep.drop("text"), FOUND)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, phrases, items, ids = sent.value
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                words, offsets = word_hashes(batch.column(at).to_pylist())
                found = [*phrases.find(words, offsets), *_verify(index, items, words, offsets)] if len(words) else []
                if clean:
                    held = np.zeros(batch.num_rows, bool)
                    held[[f[0] for f in found]] = True
                    yield batch.filter(pa.array(~held))
                elif found:
                    told = [(f, item_id) for f in found for item_id in ids[f[1]]]
                    rows = pa.array([f[0] for f, _ in told])
                    own = [c.take(rows) for k, c in enumerate(batch.columns) if k != at]
                    made = [[i for _, i in told], [f[2] for f, _ in told], [len(items[f[1]]) for f, _ in told], [f[3] for f, _ in told], [f[4] for f, _ in told]]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(m, pa.int64()) for m in made)], names=schema.names)

    return keep.mapInArrow(run, schema)


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

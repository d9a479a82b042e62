"""Words of text that is written without spaces: learned from a corpus, and found again along the most probable path.

A run of characters is a word if its parts come together more often than by chance and if what stands before and behind it
varies. A text's words are those of the path whose word probabilities have the largest product; their tags are those
of the most probable sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import by_row
from ..functions.tokens import RUN, is_word_sign
from ..sources.shared import written

#: Words that a model holds at most; it goes to every worker.
MOST_WORDS = 500_000
CJK = "[\\u4e00-\\u9fa5]+"


def gram_counts(texts: DataFrame, longest: int, text: str = "text", runs: str = CJK) -> DataFrame:
    """(gram, n, total): how often each run of 1 to longest + 1 characters comes, and all characters. Counted before they are shuffled."""
    every = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(runs), F.lit(0))).alias("run")).where("run != ''")
    pieces = lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - (k - 1)), lambda i: F.substring("run", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = every.select(F.explode(F.concat(*(pieces(k) for k in range(1, longest + 2)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def _variety(grams: DataFrame, word: Column, name: str) -> DataFrame:
    """(word, name): the entropy of the characters on one side of each word; the ends of runs count as one more character."""
    longer = grams.where(F.length("gram") > 1).groupBy(word.alias("_w")).agg(F.sum("n").alias("_met"), F.sum(F.col("n") * F.log("n")).alias("_s"))
    met = grams.join(longer, F.col("gram") == F.col("_w"), "left")
    ends = F.col("n") - F.coalesce("_met", F.lit(0))
    inner = F.coalesce("_s", F.lit(0.0)) + F.when(ends > 0, ends * F.log(ends)).otherwise(0.0)
    return met.select(F.col("gram").alias("word"), (F.log("n") - inner / F.col("n")).alias(name))


def learned_words(texts: DataFrame, longest: int = 4, least: int = 5, together: float = 20.0, variety: float = 0.8, text: str = "text", runs: str = CJK) -> DataFrame:
    """(word, n, together, variety) of the corpus's own words of 2 to longest characters that come at least `least` times.

    together is how many times more often a word comes than its two parts would by chance, for the cut for which that is
    least; variety the smaller entropy, in nats, of what stands before and behind it. Both must reach their limits. texts
    is grouped by runs of characters alone, so no text has to fit a task's memory beside its own row; a null text has no runs.
    """
    grams = written(gram_counts(texts, longest, text, runs), "grams")
    total = float(grams.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 0)
    words = grams.where((F.col("n") >= least) & F.length("gram").between(2, longest)).select(F.col("gram").alias("word"), "n")
    cuts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"), "n")
    cuts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("a"), F.substring("word", F.col("at") + 1, F.length("word")).alias("b"))
    parts = grams.where(F.col("n") >= least)
    met = cuts.join(parts.select(F.col("gram").alias("a"), F.col("n").alias("n_a")), "a").join(parts.select(F.col("gram").alias("b"), F.col("n").alias("n_b")), "b")
    bound = met.groupBy("word", "n").agg(F.max(F.col("n_a").cast("double") * F.col("n_b")).alias("chance"))
    bound = bound.select("word", "n", (F.col("n") * F.lit(total) / F.col("chance")).alias("together")).where(F.col("together") >= together)
    behind = _variety(grams, F.expr("substring(gram, 1, length(gram) - 1)"), "behind")
    before = _variety(grams, F.expr("substring(gram, 2)"), "before")
    both = bound.join(behind, "word").join(before, "word").select("word", "n", "together", F.least("before", "behind").alias("variety"))
    return both.where(F.col("variety") >= variety)


class Trie:
    """Words and their values in two arrays: a step from state s by a character with code c leads to base[s] + c, if check says that it came from s."""

    def __init__(self, words: Mapping[str, float]):
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        size, free = 1024, 1
        base, check, value = [0] * size, [-1] * size, [math.nan] * size
        check[0] = 0
        todo: list[tuple[int, list[str], int]] = [(0, sorted(words), 0)]
        while todo:
            state, own, depth = todo.pop()
            if own and len(own[0]) == depth:
                value[state] = words[own[0]]
                own = own[1:]
            if not own:
                continue
            groups: dict[int, list[str]] = {}
            for w in own:
                groups.setdefault(self.code[w[depth]], []).append(w)
            codes = sorted(groups)
            at = max(1 - codes[0], free - codes[0])  # the first free place takes the first child, if the others' are free too
            while True:
                if (more := at + codes[-1] + 1 - len(check)) > 0:
                    more += len(check)
                    base, check, value = base + [0] * more, check + [-1] * more, value + [math.nan] * more
                if all(check[at + c] < 0 for c in codes):
                    break
                at += 1
            base[state] = at
            for c in codes:
                check[at + c] = state
                todo.append((at + c, groups[c], depth + 1))
            while free < len(check) and check[free] >= 0:
                free += 1
        self.base, self.check, self.value = base, check, value

    def found(self, text: str, start: int) -> Iterator[tuple[int, float]]:
        """(end, value) of all words that begin at a place, the shortest first."""
        state = 0
        for end in range(start, len(text)):
            code = self.code.get(text[end])
            if code is None:
                return
            to = self.base[state] + code
            if not 0 < to < len(self.check) or self.check[to] != state:
                return
            state = to
            if self.value[state] == self.value[state]:
                yield end + 1, self.value[state]


@dataclass
class Model:
    """Words with their numbers, tags of some, and how often a tag follows another."""

    counts: Mapping[str, float]
    tags: Mapping[str, str] = field(default_factory=dict)
    follows: Mapping[tuple[str, str], float] = field(default_factory=dict)

    def __post_init__(self):
        if len(self.counts) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words")
        total = sum(self.counts.values()) + 1.0
        self.trie = Trie({w: math.log(n / total) for w, n in self.counts.items() if n > 0})
        #: A character that is no word of its own comes less often than any word.
        self.unknown = math.log(0.5 / total)
        self.names = sorted({*self.tags.values(), "n"})
        at = {t: i for i, t in enumerate(self.names)}
        moves = np.ones((len(self.names), len(self.names)))
        for (a, b), n in self.follows.items():
            if a in at and b in at:
                moves[at[a], at[b]] += n
        self._moves = np.log(moves / moves.sum(1, keepdims=True))

    def path(self, run: str) -> list[str]:
        """The words of the most probable path through a run of characters; of two as probable, that whose later words are longer."""
        n = len(run)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for start in range(n):
            alone = True
            for end, value in self.trie.found(run, start):
                alone &= end > start + 1
                if best[start] + value > best[end]:
                    best[end], back[end] = best[start] + value, start
            if alone and best[start] + self.unknown > best[start + 1]:
                best[start + 1], back[start + 1] = best[start] + self.unknown, start
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """A text's words in order: runs of signs are cut along the path, other runs of letters stay whole."""
        return [w for run in RUN.findall(text) for w in (self.path(run) if is_word_sign(run[0]) else [run])]

    def tagged(self, words: Sequence[str]) -> list[str]:
        """The most probable tags: a known word has its own, any other may have each; runs of other letters are eng and begin anew."""
        out: list[str] = []
        held: list[str] = []
        for w in [*words, ""]:
            if w and is_word_sign(w[0]):
                held.append(w)
                continue
            out += self._viterbi(held)
            held = []
            if w:
                out.append("eng")
        return out

    def _viterbi(self, words: list[str]) -> list[str]:
        if not words:
            return []
        told = [np.array([0.0 if self.tags.get(w, t) == t else -math.inf for t in self.names]) for w in words]
        score, back = told[0], []
        for own in told[1:]:
            every = score[:, None] + self._moves + own
            back.append(every.argmax(0))
            score = every.max(0)
        at = [int(score.argmax())]
        for came in reversed(back):
            at.append(int(came[at[-1]]))
        return [self.names[k] for k in reversed(at)]


def with_transitions(texts: DataFrame, model: Model, text: str = "text") -> Model:
    """The model with how often, over all texts, a word of one tag follows a word of another; words without a tag say nothing."""
    tags = model.tags

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for t in batch.column(0):
                words = model.words(t.as_py() or "")
                for a, b in zip(words, words[1:]):
                    if a in tags and b in tags:
                        seen[tags[a], tags[b]] = seen.get((tags[a], tags[b]), 0) + 1
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in seen], pa.string()), "b": pa.array([b for _, b in seen], pa.string()), "n": pa.array(seen.values(), pa.int64())})

    rows = texts.select(text).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # a row for each pair of tags
    return Model(model.counts, model.tags, {(r["a"], r["b"]): float(r["n"]) for r in rows})


def learn(texts: DataFrame, tags: Mapping[str, str] | None = None, known: Mapping[str, float] | None = None, text: str = "text", **limits) -> Model:
    """A model of a corpus: its own words, known ones (with numbers) besides, and transitions between the tags that are given."""
    found = learned_words(texts, text=text, **limits).select("word", "n").orderBy(F.desc("n"), "word").limit(MOST_WORDS + 1).collect()
    counts = dict(known or {}) | {r["word"]: float(r["n"]) for r in found}
    return with_transitions(texts, Model(counts, dict(tags or {})), text)


def path_tokens(text: Column, model: Model) -> Column:
    """Words of a text along the most probable path, as an array."""
    return by_row("array<string>", lambda t: model.words(t) if t else [], text)


def path_tagged(text: Column, model: Model) -> Column:
    """(word, tag) of a text along the most probable path and sequence of tags."""

    def one(t: str | None) -> list[tuple[str, str]]:
        words = model.words(t or "")
        return list(zip(words, model.tagged(words)))

    return by_row("array<struct<word: string, tag: string>>", one, text)

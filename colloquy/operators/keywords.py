"""Keywords, term counts and topics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.rowwise import by_row
from ..functions.text import WHITE, has
from ..functions.tokens import tagger, within_latin


def term_counts(terms: DataFrame, key: str, term: str = "word", at: str = "at") -> DataFrame:
    """(key, word, frequency, first, total): how often each key has each term, where first, and all of its terms."""
    counts = terms.groupBy(key, term).agg(F.count("*").alias("frequency"), F.min(at).alias("first"))
    return counts.withColumn("total", F.sum("frequency").over(Window.partitionBy(key)))


def top(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank. Ranks above n never leave the task that finds them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def _without_signs(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")


def english_terms(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, word): lower-cased words without signs, stop words and words of one or two letters."""
    plain = _without_signs(text)
    stop = F.array(*map(F.lit, L.STOP_WORDS_EN))
    split = F.filter(F.split(plain, r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return texts.select(key, F.posexplode(split).alias("at", "word"))


def keywords_en(texts: DataFrame, key: str, text: str = "text", n: int = 10) -> DataFrame:
    """(key, rank, word, frequency, score): the n most frequent words; ties go to the one that comes first."""
    counts = term_counts(english_terms(texts, key, text), key)
    best = top(counts, key, n, F.desc("frequency"), F.asc("first"))
    return best.select(key, "rank", "word", "frequency", (F.col("frequency") / F.col("total")).alias("score"))


def best_words_en(text: Column, n: int = 10) -> Column:
    """The first n words of `keywords_en`, an array, on a text's own row: nothing is shuffled or joined."""
    white, stop = re.compile(f"[{WHITE}]+"), frozenset(L.STOP_WORDS_EN)

    def one(text: str | None) -> list[str]:
        counts = Counter(w for w in white.split(text or "") if len(w) > 2 and w not in stop)
        return sorted(counts, key=lambda w: -counts[w])[:n]  # of equal ones the first comes first

    return by_row("array<string>", one, _without_signs(text))


def _bonus(tag: Column) -> Column:
    return F.when(tag.isin("nz", "nr", "ns", "nt"), 1.5).when(tag.isin("n", "vn"), 1.3).when(tag == "v", 1.1).otherwise(1.0)


def keywords_zh(texts: DataFrame, key: str, text: str = "text", words: str = "tagged", n: int = 10) -> DataFrame:
    """(key, rank, word, frequency, score): words by frequency, rarity among the text's sentences, and part of speech.

    words is a column of (word, tag). A sentence counts for a word if it contains it anywhere. A tag is that of the
    word's first place in the text. Rows are ordered by their rounded scores, ties by first place.
    """
    stop = sorted({*L.STOP_WORDS_ZH, *L.DOMAIN_STOP_WORDS_ZH})
    every = texts.select(key, F.posexplode(words).alias("at", "w")).select(key, "at", "w.word", "w.tag")
    kept = F.col("tag").isin(L.KEYWORD_TAGS) & ~F.col("word").isin(stop) & (F.length("word") >= 2) & F.col("word").rlike("^[\\u4e00-\\u9fa5a-zA-Z0-9]+")
    counts = every.groupBy(key, "word").agg(F.sum(kept.cast("long")).alias("frequency"), F.min(F.when(kept, F.col("at"))).alias("first"), F.min_by("tag", "at").alias("tag")).where("frequency > 0")
    counts = counts.withColumn("total", F.sum("frequency").over(Window.partitionBy(key)))
    sentences = texts.select(F.col(key).alias("_k"), F.split(text, "[。！？\n]").alias("sentences"))
    scored = counts.join(sentences, F.col(key) == F.col("_k"))
    inside = F.size(F.filter("sentences", lambda s: F.contains(s, F.col("word"))))
    idf = F.log((F.size("sentences") + 1) / (inside + 1)) + 1
    scored = scored.withColumn("score", F.bround(F.col("frequency") / F.col("total") * idf * _bonus(F.col("tag")), 4))
    return top(scored, key, n, F.desc("score"), F.asc("first")).select(key, "rank", "word", "frequency", "score")


WORDS = "array<struct<word: string, frequency: bigint, score: double>>"
_BONUS = {"nz": 1.5, "nr": 1.5, "ns": 1.5, "nt": 1.5, "n": 1.3, "vn": 1.3, "v": 1.1}
_WORD = re.compile("[\u4e00-\u9fa5a-zA-Z0-9]")


def word_scorer(n: int = 10, alone: bool = True) -> Callable[..., list[dict]]:
    """What finds the first n words of one text, as `best_words` has them; unless alone, its (word, tag) are given, too."""
    words_of = tagger()
    stop = frozenset((*L.STOP_WORDS_ZH, *L.DOMAIN_STOP_WORDS_ZH))

    def one(text: str | None, given: list[dict] | None = None) -> list[dict]:
        if alone and within_latin(text or ""):  # runs of other letters are no keywords
            return []
        words = words_of(text) if alone else [(w["word"], w["tag"]) for w in given or ()]
        tags: dict[str, str] = {}
        for w, tag in words:
            tags.setdefault(w, tag)
        counts = Counter(w for w, tag in words if tag in L.KEYWORD_TAGS and w not in stop and len(w) >= 2 and _WORD.match(w))
        total, sentences = sum(counts.values()), re.split("[。！？\n]", text or "")
        scored = []
        for word, frequency in counts.items():  # in order of their first places
            inside = sum(word in s for s in sentences)
            idf = math.log((len(sentences) + 1) / (inside + 1)) + 1
            scored.append({"word": word, "frequency": frequency, "score": round(frequency / total * idf * _BONUS.get(tags[word], 1.0), 4)})
        return sorted(scored, key=lambda x: -x["score"])[:n]

    return one


def best_words(text: Column, tagged: Column | None = None, n: int = 10) -> Column:
    """The first n words of `keywords_zh`, an array of (word, frequency, score), on a text's own row: nothing is shuffled or joined,
    and without a column tagged, of (word, tag), its words are none either."""
    return by_row(WORDS, word_scorer(n, tagged is None), text, *([] if tagged is None else [tagged]))


SENTENCE_COUNTS = "struct<sentences: int, total: bigint, words: array<struct<word: string, frequency: bigint, inside: int>>>"


def _held_in(words: Mapping[str, object], least: int) -> dict[str, list[str]]:
    """For each word that others contain, which they are. Words have so many letters at least: at each place of a word those are
    tried that begin like what is there."""
    starts: dict[str, list[str]] = {}
    for word in words:
        starts.setdefault(word[:least], []).append(word)
    holders: dict[str, list[str]] = {}
    for word in words:
        for at in range(len(word) - least + 1):
            for part in starts.get(word[at : at + least], ()):
                if len(part) < len(word) and word.startswith(part, at):
                    holders.setdefault(part, []).append(word)
    return holders


def sentence_counts(text: Column, least: int = 5) -> Column:
    """struct(sentences, total, words) of a text in lower case: how many sentences are not blank, how many words have so many letters
    of a to z, and of each different one its frequency and how many sentences contain it, within a longer word, too.

    A word of letters alone lies in one run of letters wherever it occurs, so that its sentences are those of the words that
    contain it: no sentence is searched for a word, and nothing is shuffled.
    """
    run, end = re.compile(f"[a-z]{{{least},}}"), re.compile("[.!?\n]")

    def one(text: str | None) -> tuple:
        own = [s for s in end.split(text or "") if s.strip(" ")]
        found = [run.findall(s) for s in own]
        counts = Counter(w for ws in found for w in ws)
        places: dict[str, set[int]] = {w: set() for w in counts}
        for i, ws in enumerate(found):
            for w in ws:
                places[w].add(i)
        holders = _held_in(counts, least)
        inside = {w: len(places[w].union(*(places[x] for x in holders[w])) if w in holders else places[w]) for w in counts}
        return len(own), counts.total(), [(w, n, inside[w]) for w, n in counts.items()]

    return by_row(SENTENCE_COUNTS, one, text)


def document_frequency(texts: DataFrame, lexicon: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """(word, documents): for each word of a lexicon, how many texts contain it; one pass, one row per word and task shuffled."""
    found = F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(F.col(text), w))
    return texts.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))


TOPICS = "array<struct<topic: string, score: double, keyword_hits: bigint, total_hits: bigint>>"


def topic_scorer(topics: Sequence[str] | None = None, words: Mapping[str, Sequence[str]] | None = None, n: int = 5) -> Callable[[str | None], list[tuple]]:
    """What finds the n topics of one text, as `keyword_topics` has them, with scores that are not rounded."""
    words = L.TOPICS if words is None else words
    listed = [(topic, list(words.get(topic, []))) for topic in topics or list(words)]
    every = {w for _, own in listed for w in own}
    foreign = not any(map(within_latin, every))

    def one(text: str | None) -> list[tuple]:
        if text and foreign and within_latin(text):
            return nothing
        counts = {w: text.count(w) if text else 0 for w in every}
        least = max(len(text or "") / 100, 1.0)
        out = []
        for topic, own in listed:
            found, total = sum(counts[w] > 0 for w in own), sum(counts[w] for w in own)
            density = min(total / least, 1.0)
            if text is None and own:  # what is not there is no count, and as dense as can be
                total, density = None, 1.0
            out.append((topic, found / max(len(own), 1) * 0.6 + density * 0.4, found, total))
        return sorted(out, key=lambda t: -t[1])[:n]

    nothing = one("")
    return one


def rounded_topics(topics: Column) -> Column:
    """What `topic_scorer` finds, with scores of four places."""
    return F.transform(topics, lambda t: F.struct(t["topic"].alias("topic"), F.bround(t["score"], 4).alias("score"), t["keyword_hits"].alias("keyword_hits"), t["total_hits"].alias("total_hits")))


def keyword_topics(text: Column, topics: Sequence[str] | None = None, words: Mapping[str, Sequence[str]] | None = None, n: int = 5) -> Column:
    """The n topics whose words text has most: 0.6 for the share of words found, 0.4 for their density; ties as listed.

    A word that a topic lists twice counts twice. Nothing is shuffled, and a text goes to Python once for all words.
    """
    return rounded_topics(by_row(TOPICS, topic_scorer(topics, words, n), text))


def semantic_topics(text: Column, similarities: Mapping[str, Column], words: Mapping[str, Sequence[str]] | None = None, n: int = 5) -> Column:
    """The n topics with the highest 0.7 * similarity + 0.3 * share of words found; similarities come from a model of the caller's."""
    words = L.TOPICS if words is None else words
    made = []
    for k, (topic, similarity) in enumerate(similarities.items()):
        own = words.get(topic, [])
        share = F.least(sum((has(text, w).cast("long") for w in own), F.lit(0)) / max(len(own), 1), F.lit(1.0))
        score = similarity * 0.7 + share * 0.3
        made.append(F.struct((-score).alias("order"), F.lit(k).alias("place"), F.lit(topic).alias("topic"), F.bround(score, 4).alias("score"), F.bround(similarity, 4).alias("semantic_score"), F.bround(share, 4).alias("keyword_score")))
    best = F.slice(F.array_sort(F.array(*made)), 1, n)
    return F.transform(best, lambda t: F.struct(*(t[x].alias(x) for x in ("topic", "score", "semantic_score", "keyword_score"))))

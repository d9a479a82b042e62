"""Extractive summaries, each step an expression over a text's own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.rowwise import by_row
from ..functions.tokens import default_lexicon, long_words
from ..functions.tokens import tokens as zh_tokens
from ..operators.keywords import TOPICS, WORDS, rounded_topics, topic_scorer, word_scorer
from ..operators.sentences import cut, ranker, suppress_repeats

TOO_SHORT = "内容过短，无法生成摘要"


#: What is told of a text before candidates are compared: whether it is too short, how many sentences, the best, the first and the action items as reports tell them, the whole one if short.
GIST = f"struct<brief: boolean, sentences: int, best: array<string>, first: array<string>, items: array<string>, short: string, words: {WORDS}, topics: {TOPICS}>"
SAID = "struct<before: array<string>, fresh: array<string>>"


def gist() -> Callable[[str, list[str]], tuple]:
    """What finds the GIST of a text and its action items: the text goes to Python once, and its sentences stay there."""
    words_of, best_of, topics_of = word_scorer(20), ranker(15), topic_scorer()

    def one(text: str, items: list[str]) -> tuple:
        every, words, told = cut(text), words_of(text), {}
        best, first = best_of(every, [w["word"] for w in words]), every[:8]
        for x in (*best, *first, *items):
            if x not in told:
                told[x] = R.rewrite(x, ("narrated", "tidied"))
        short = R.rewrite(text, ("narrated", "tidied")) if len(every) <= 2 else None
        return len(text.strip(T.WHITE)) < 20, len(every), [told[x] for x in best], [told[x] for x in first], [told[x] for x in items], short, words, topics_of(text)

    return one


def chosen() -> Callable[..., tuple]:
    """What chooses, of an opening (or none), good sentences, spare ones if there are none, and action items, what a summary says: SAID.

    Tokens of one character are left out. Sentences with the same tokens, or with more than 0.6 of them in common, are repeats; each
    candidate's tokens are found, sorted and made a set once, and not for each pair.
    """
    known = frozenset(default_lexicon())
    longest = max(map(len, known))

    def one(opening: str | None, good: list[str], spare: list[str] | None, actions: list[str]) -> tuple:
        spare = spare or []
        met: dict[str, tuple[frozenset[str], str]] = {}

        def of(x: str) -> tuple[frozenset[str], str]:
            if x not in met:
                words = long_words(x, known, longest)
                met[x] = frozenset(words), "".join(sorted(words))[:30]
            return met[x]

        def same(x: str, y: str) -> bool:
            return of(x)[1] == of(y)[1]

        def similar(x: str, y: str) -> float:
            a, b = of(x)[0], of(y)[0]
            common = len(a & b)
            return common / (len(a) + len(b) - common) if common else 0.0

        def first(items: list[str], near: Callable[[str, str], bool], most: int) -> list[str]:
            kept: list[str] = []
            for x in items:
                if len(kept) < most and not any(near(x, y) for y in kept):
                    kept.append(x)
            return kept

        kept = first(good, lambda x, y: same(x, y) or similar(x, y) > 0.6, 6) or first(spare, same, 5)
        core = [x for x in kept if len(x) >= 15 and not (opening is not None and similar(x, opening) > 0.4)][:4]
        before = core if opening is None else [opening, *core]
        return before, [x for x in actions if not any(similar(x, y) > 0.5 for y in before)][:2]

    return one


def summaries(texts: DataFrame, key: str, max_length: int = 500, model_summary: str | None = None) -> DataFrame:
    """(key, summary, keywords, topics) of Chinese meeting texts (key, text); see `summarised`."""
    return summarised(texts, max_length, model_summary).select(key, "summary", "keywords", "topics")


def summarised(texts: DataFrame, max_length: int = 500, model_summary: str | None = None) -> DataFrame:
    """texts (with text) plus summary, keywords and topics, replacing columns of these names.

    The best sentences by rank are narrated, tidied, checked and freed of near repeats; an opening names topics and
    keywords; up to four sentences and two action items follow that say something else. model_summary names a
    column with a model's summaries, taken instead where not null, longer than 20 characters and not invented.
    A null text is summed up as an empty one. Every step is an expression or an Arrow step on a text's own row.
    """
    given = [c for c in texts.columns if c not in ("summary", "keywords", "topics")]
    rows = texts.select(*(F.col(c).alias(f"given {c}") for c in given), F.coalesce("text", F.lit("")).alias("text"), (F.col(model_summary) if model_summary else F.lit(None).cast("string")).alias("model"))
    rows = rows.withColumn("gist", by_row(GIST, gist(), F.col("text"), F.slice(T.action_items(F.col("text")), 1, 3)))
    rows = rows.withColumns({"keywords": F.slice("gist.words", 1, 10), "topics": rounded_topics(F.col("gist.topics")), "model_told": R.rewritten(F.col("model"), "tidied") if model_summary else F.col("model")})
    rows = rows.withColumn("names", F.transform("keywords", lambda k: k["word"]))

    # a column of its own, as it is used twice: a Python step can't have an argument with a lambda inside a lambda
    rows = rows.withColumn("good", F.filter("gist.best", lambda x: T.worth_a_summary(x, F.col("names"))))
    spare = F.when(F.size("good") == 0, F.filter("gist.first", lambda x: F.length(x) > 15))
    actions = F.filter("gist.items", lambda x: F.length(x) > 10)
    rows = rows.withColumn("top_topics", F.transform(F.filter(F.slice("topics", 1, 2), lambda t: t["score"] > 0.2), lambda t: t["topic"]))
    named = F.slice(F.filter(F.slice("names", 1, 8), lambda w: ~F.array_contains(F.col("top_topics"), w) & (F.length(w) > 1)), 1, 5)
    subject = F.concat(F.lit("本次会议围绕"), F.array_join("top_topics", "与"), F.lit("展开讨论"))
    opening = F.when(F.size("top_topics") > 0, F.when(F.size(named) > 0, F.concat(subject, F.lit("，涉及"), F.array_join(named, "、"), F.lit("等核心内容。"))).otherwise(F.concat(subject, F.lit("。"))))
    rows = rows.withColumn("said", by_row(SAID, chosen(), opening, F.col("good"), spare, actions))

    before, fresh = F.col("said.before"), F.col("said.fresh")
    parts = F.concat(before, F.when(F.size(fresh) > 0, F.array(F.concat(F.lit("会议明确"), F.array_join(fresh, "；")))).otherwise(F.array().cast("array<string>")))
    model_ok = (F.length("model") > 20) & ~T.invented(F.col("model"), F.col("text"), zh_tokens(F.col("model")), zh_tokens(F.col("text"))) if model_summary else F.lit(False)
    whole = T.finished(F.when(F.coalesce(model_ok, F.lit(False)), F.col("model_told")).otherwise(F.array_join(parts, "。")))
    short = F.substring("gist.short", 1, max_length)
    rows = rows.withColumn("whole", whole)
    out = F.when(F.col("gist.brief"), F.lit(TOO_SHORT)).when(F.col("gist.sentences") <= 2, short).otherwise(fitted(F.col("whole"), max_length))
    return rows.select(*(F.col(f"given {c}").alias(c) for c in given), out.alias("summary"), "keywords", "topics")


def fitted(c: Column, most: int) -> Column:
    """At most so many characters: cut after the last stop if that is past the middle, else with dots; a stop at the end where one fits."""
    cut = F.substring(c, 1, most - 1)
    stop = F.length(cut) - F.instr(F.reverse(cut), F.lit("。"))
    short = F.when(F.contains(cut, F.lit("。")) & (stop > most * 0.5), F.substring(cut, F.lit(1), stop + 1)).otherwise(F.concat(F.substring(cut, 1, most - 3), F.lit("...")))
    out = F.when(F.length(c) > most, short).otherwise(c)
    return F.when(~out.endswith("。") & (F.length(out) < most) & (F.length(out) > 5), F.concat(out, F.lit("。"))).otherwise(out)


def core_points(texts: DataFrame, key: str, keywords: Callable[[], Column] | Column, most: int = 3) -> DataFrame:
    """(key, points): the sentences that say most, narrated, without near repeats. texts has an array `sentences`."""
    words = keywords() if callable(keywords) else keywords
    texts = texts.withColumn("told", R.all_rewritten(F.col("sentences"), "narrated"))
    told = F.col("told")
    first = suppress_repeats(F.filter(told, lambda s: F.length(s) >= 15), lambda x, y: F.substring(x, 1, 20) == F.substring(y, 1, 20), 1 << 20)
    good = F.filter(first, lambda s: T.makes_a_point(s, words))
    scored = F.filter(F.transform(good, lambda s, i: F.struct((-T.point_score(s, words)).alias("o"), i.alias("i"), s.alias("s"))), lambda x: x["o"] < 0)
    ordered = F.transform(F.array_sort(scored), lambda x: x["s"])
    near = lambda x, y: (T.character_share(x, y) > 0.6) | F.contains(y, F.substring(x, 1, 15)) | F.contains(x, F.substring(y, 1, 15))
    return texts.select(key, suppress_repeats(ordered, near, most).alias("points"))

"""Sentiment by a lexicon, as one pass over a text's words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L


def _table(weights: Mapping[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for w, s in weights.items() for x in (w, float(s))))


def sentiment(
    tokens: Column,
    positive: Mapping[str, float] | None = None,
    negative: Mapping[str, float] | None = None,
    neutral: Sequence[str] | None = None,
    negation: Sequence[str] | None = None,
    degree: Mapping[str, float] | None = None,
) -> Column:
    """struct(sentiment, score, positive, negative, positive_score, negative_score) of an array of words.

    Words are taken in units: at most one word of degree, at most one negation, then a word that may have a side.
    A neutral word in front of a unit is passed over. A negated word counts for the other side. The fold's state is
    what the unit has so far: nothing, a degree, or a negation with or without a degree.
    """
    positive, negative = positive if positive is not None else L.POSITIVE_WORDS, negative if negative is not None else L.NEGATIVE_WORDS
    sides = F.map_from_arrays(F.array(*map(F.lit, [*positive, *(w for w in negative if w not in positive)])), F.array(*(F.lit(float(x)) for x in [*positive.values(), *(-negative[w] for w in negative if w not in positive)])))
    degrees = _table(degree if degree is not None else L.DEGREE_WORDS)
    turns = F.array(*map(F.lit, negation if negation is not None else L.NEGATION_WORDS))
    plain = F.array(*map(F.lit, neutral if neutral is not None else L.NEUTRAL_WORDS))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0).alias("state"), F.lit(1.0).alias("degree"))

    def step(s: Column, w: Column) -> Column:
        by, side = F.try_element_at(degrees, w), F.coalesce(F.try_element_at(sides, w), F.lit(0.0))
        turn = F.array_contains(turns, w)
        value = F.abs(side) * s["degree"]
        good = (side > 0) != (s["state"] == 2)
        keep = lambda state, d: F.struct(s["p"].alias("p"), s["n"].alias("n"), F.lit(state).alias("state"), d.alias("degree"))
        return (
            F.when((s["state"] == 0) & F.array_contains(plain, w), s)
            .when((s["state"] == 0) & by.isNotNull(), keep(1, F.coalesce(by, F.lit(1.0))))
            .when((s["state"] < 2) & turn, keep(2, s["degree"]))
            .otherwise(
                F.struct(
                    (s["p"] + F.when((side != 0) & good, value).otherwise(0.0)).alias("p"),
                    (s["n"] + F.when((side != 0) & ~good, value).otherwise(0.0)).alias("n"),
                    F.lit(0).alias("state"),
                    F.lit(1.0).alias("degree"),
                )
            )
        )

    def finish(s: Column) -> Column:
        total = s["p"] + s["n"]
        score = F.coalesce(F.try_divide(s["p"], total), F.lit(0.5))
        return F.struct(
            F.when(score > 0.55, "positive").when(score < 0.45, "negative").otherwise("neutral").alias("sentiment"),
            F.bround(score, 4).alias("score"),
            F.lit(0).alias("positive"),
            F.lit(0).alias("negative"),
            F.bround(s["p"], 2).alias("positive_score"),
            F.bround(s["n"], 2).alias("negative_score"),
        )

    return F.aggregate(tokens, start, step, finish)


def from_model_score(score: Column) -> Column:
    """The same struct from a model's probability that a text is positive."""
    return F.struct(
        F.when(score > 0.6, "positive").when(score < 0.4, "negative").otherwise("neutral").alias("sentiment"),
        F.bround(score, 4).alias("score"),
        F.lit(0).alias("positive"),
        F.lit(0).alias("negative"),
        F.bround(score, 2).alias("positive_score"),
        F.bround(1 - score, 2).alias("negative_score"),
    )

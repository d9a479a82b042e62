"""Everything that is told about a meeting, for all meetings of a table at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..operators import compliance, sentiment, timeline
from .summary import summarised


def meeting_texts(segments: DataFrame) -> DataFrame:
    """(meeting_id, text, segments, duration, participants): one row for each meeting, from segments in order."""
    every = F.array_sort(F.collect_list(F.struct("idx", "start_time", "end_time", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("speaker", F.lit("unknown")).alias("speaker"))))
    rows = segments.groupBy("meeting_id").agg(every.alias("s"))
    return rows.select(
        "meeting_id",
        F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"),
        F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time"))).alias("segments"),
        F.coalesce(F.element_at("s", -1)["end_time"], F.lit(0.0)).cast("int").alias("duration"),
        F.size(F.array_distinct(F.transform("s", lambda x: x["speaker"]))).alias("participants"),
    )


def analyze(segments: DataFrame, items: Sequence[compliance.Item], weights: Mapping[str, float] | None = None, speakers: DataFrame | None = None, max_length: int = 500) -> DataFrame:
    """One row for each meeting: keywords, topics, summary, sentiment and the compliance report of its segments.

    Segments are gathered once by meeting; all else is done on that row. With speakers (meeting_id, idx, start,
    end, speaker), segments first take theirs.
    """
    if speakers is not None:
        segments = timeline.assign_speakers(segments, speakers, "meeting_id")
    texts = meeting_texts(segments)
    felt = texts.withColumn("sentiment", sentiment.sentiment(tokens(F.col("text"))))
    return summarised(compliance.score(felt, items, weights, tokens), max_length)


def analyze_text(texts: DataFrame, key: str) -> DataFrame:
    """(key, summary, keywords, topics, sentiment) of texts that are no meetings' segments."""
    felt = texts.withColumn("sentiment", sentiment.sentiment(tokens(F.coalesce("text", F.lit("")))))
    return summarised(felt).select(key, "summary", "keywords", "topics", "sentiment")

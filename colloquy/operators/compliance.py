"""Scoring of meetings against a knowledge base.

The knowledge base is a policy team's table. Its active items become literals of the plan, after a check of how
many there are, so that scoring a meeting is one expression over its own row: nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.text import difference, jaccard, negated, score_level, severity, strip, words

WEIGHTS = {"semantic_similarity": 40.0, "point_coverage": 30.0, "risk_detection": 20.0, "keyword_matching": 10.0}
MOST_ITEMS = 2000
MARKER = "array<struct<keyword: string, category: string, start_time: double, end_time: double, text: string, severity: string>>"
SEGMENTS = "array<struct<text: string, start_time: double, end_time: double>>"
GROUPS = {"policy": "policy", "meeting_spirit": "policy", "required": "points", "key_points": "points", "risk_keywords": "risk", "forbidden": "risk"}


@dataclass
class Item:
    title: str
    content: str
    group: str | None
    keywords: list[str] = field(default_factory=list)
    points: list[str] = field(default_factory=list)


def active_items(kb: DataFrame) -> list[Item]:
    """The knowledge base's active items by id; more than MOST_ITEMS are refused, as they would no longer fit a plan."""
    rows = kb.where("status = 'active'").orderBy("id").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} active items")
    return [Item(r["title"] or "", r["content"] or "", GROUPS.get(r["item_type"]), list(r["keywords"] or []), list(r["required_points"] or [])) for r in rows]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>") if values else F.array().cast("array<string>")


def _tokens_of(spark: SparkSession, texts: Sequence[str], tokens: Callable[[Column], Column]) -> list[list[str]]:
    """Tokens of the knowledge base's own texts, told once by a small job, so that no row asks for them again."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tokens(F.lower("text")).alias("t")).collect()
    return [list(r["t"] or []) for r in sorted(rows)]


def _alike(a: set[str], b: set[str]) -> float:
    """Share of common elements of two sets; 0 if either is empty."""
    return len(a & b) / len(a | b) if a and b else 0.0


def _contains(text: Column, keyword: Column) -> Column:
    return F.contains(F.lower(text), F.lower(strip(keyword)))


def risk_rows(text: Column, segments: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Markers of risky statements: for each match of a rule in the text that no negation precedes, all such matches
    of the rule in all segments; without segments, the match itself with the beginning of the text."""
    none = F.coalesce(F.size(segments), F.lit(0)) <= 0
    out = []
    for pattern, category, level in rules:
        found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: ~negated(text, m))

        def marker(keyword: Column, start: Column, end: Column, where: Column, category: str = category, level: str = level) -> Column:
            return F.struct(keyword.alias("keyword"), F.lit(category).alias("category"), start.alias("start_time"), end.alias("end_time"), where.alias("text"), F.lit(level).alias("severity"))

        def in_segment(s: Column, pattern: str = pattern, marker: Callable = marker) -> Column:
            own = F.filter(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), lambda m: ~negated(s["text"], m))
            return F.transform(own, lambda m: marker(m, s["start_time"], s["end_time"], s["text"]))

        each = F.flatten(F.transform(segments, lambda s: in_segment(s)))
        alone = F.transform(found, lambda m: marker(m, F.lit(0.0), F.lit(0.0), F.substring(text, 1, 50)))
        out.append(F.when(none, alone).otherwise(F.flatten(F.transform(found, lambda m: each))).cast(MARKER))
    return F.flatten(F.array(*out)) if out else F.array().cast(MARKER)


def suggestions(total: Column, missing: Column, risks: Column) -> Column:
    more = lambda a, n: F.when(F.size(a) > n, "...").otherwise("")
    said = F.array(
        F.when(total < 60, "会议内容与政策要求差距较大，建议重新传达"),
        F.when(F.size(missing) > 0, F.concat(F.lit("以下必传要点未覆盖："), F.array_join(F.slice(missing, 1, 5), ", "), more(missing, 5))),
        F.when(F.size(risks) > 0, F.concat(F.lit("发现风险内容："), F.array_join(F.slice(risks, 1, 3), ", "), more(risks, 3), F.lit("，请核查"))),
    )
    found = F.filter(said, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("会议内容合规，继续保持")))


def score(
    meetings: DataFrame,
    items: Sequence[Item],
    weights: Mapping[str, float] | None = None,
    tokens: Callable[[Column], Column] = words,
    rules: Sequence[tuple[str, str, str]] | None = None,
    similarity: Callable[[str], Column] | None = None,
) -> DataFrame:
    """meetings (with text and segments, an array of (text, start_time, end_time)) plus the parts of their reports.

    tokens splits a text for the similarity of token sets; similarity, if given, stands in for it: it takes a
    policy's content and returns a column of numbers. A null text is scored as an empty one.
    """
    w = dict(WEIGHTS) | dict(weights or {})
    rules = L.RISK_RULES if rules is None else rules
    kept = [c for c in meetings.columns if c not in ("text", "segments")]
    text = F.coalesce(F.col("text"), F.lit(""))
    policies, points, risks = ([i for i in items if i.group == g] for g in ("policy", "points", "risk"))
    strings = "array<string>"
    if not items:
        none = F.array().cast(strings)
        zero = F.struct(*(F.lit(0.0).alias(k) for k in WEIGHTS))
        return meetings.select(*meetings.columns, F.lit(0.0).alias("total_score"), score_level(F.lit(0.0)).alias("score_level"), zero.alias("components"), none.alias("covered_points"), F.array().cast(POINT_MARKER).alias("point_time_markers"), none.alias("missing_points"), none.alias("risk_keywords"), F.array().cast(MARKER).alias("risk_time_markers"), none.alias("matched_keywords"), F.array(F.lit("知识库为空，请先添加合规检查规则")).alias("suggestions"))
    at = meetings.withColumn("_text", text).withColumn("_segments", F.coalesce(F.col("segments").cast(SEGMENTS), F.array().cast(SEGMENTS)))
    text, segments = F.col("_text"), F.col("_segments")

    # similarity to each policy; the best one, first of equals
    said = dict.fromkeys(x for i in (*policies, *points) for x in (i.title, i.content))
    split = {x: {t for t in ts if len(t) > 1} for x, ts in zip(said, _tokens_of(meetings.sparkSession, list(said), tokens))} if policies else {}
    if similarity is None:
        at = at.withColumn("_tokens", F.array_distinct(F.filter(tokens(F.lower(text)), lambda t: F.length(t) > 1)))
        sims = [jaccard(F.col("_tokens"), _strings(sorted(split[p.content]))) for p in policies]
    else:
        sims = [similarity(p.content) for p in policies]
    if policies:
        best = F.array_sort(F.array(*(F.struct((-s).alias("o"), F.lit(k).alias("k")) for k, s in enumerate(sims))))[0]
        at = at.withColumn("_policy", best["k"]).withColumn("_sim", -best["o"])
    else:
        at = at.withColumn("_policy", F.lit(None).cast("int")).withColumn("_sim", F.lit(0.0))

    # the item with points: most keywords in the text, or the first whose title is like the best policy's
    def hits(item: Item) -> Column:
        return sum((F.contains(F.lower(text), F.lit(k.lower())).cast("int") for k in item.keywords if k), F.lit(0))

    if points:
        most = F.array_sort(F.array(*(F.struct((-hits(i)).alias("o"), F.lit(k).alias("k")) for k, i in enumerate(points))))[0]
        chosen = F.when(most["o"] < 0, most["k"])
        like = {p: k for p, policy in enumerate(policies) if (k := next((k for k, i in enumerate(points) if _alike(split[policy.title], split[i.title]) > 0.3), None)) is not None}
        if like:
            by_title = F.create_map(*(F.lit(x) for pair in like.items() for x in pair))
            chosen = F.coalesce(F.when(F.col("_sim") > 0.1, F.try_element_at(by_title, F.col("_policy"))), chosen)
        at = at.withColumn("_point", chosen)
    else:
        at = at.withColumn("_point", F.lit(None).cast("int"))

    def pick(values: Sequence[Column], index: str) -> Column | None:
        return reduce(lambda rest, kv: F.when(F.col(index) == kv[0], kv[1]).otherwise(rest), reversed(list(enumerate(values))), F.lit(None).cast(strings)) if values else F.lit(None).cast(strings)

    own_points = F.coalesce(pick([_strings([x for x in i.points if x]) for i in points], "_point"), F.array().cast(strings))
    own_keys = F.coalesce(pick([_strings(list(dict.fromkeys(x for x in i.keywords if x))) for i in points], "_point"), F.array().cast(strings))
    first_point = F.coalesce(*([F.when(F.col("_point") == k, F.lit(i.points[0])) for k, i in enumerate(points) if i.points] or [F.lit(None).cast("string")]))
    source = F.coalesce(*([F.when(F.col("_point") == k, F.lit(i.title)) for k, i in enumerate(points)] or [F.lit(None).cast("string")]))
    at = at.withColumn("_required", own_points).withColumn("_hit", F.filter(own_keys, lambda k: _contains(text, k))).withColumn("_first", first_point).withColumn("_source", source)
    covered = F.when(F.size("_hit") > 0, F.array_distinct("_required")).otherwise(F.array().cast(strings))

    def point_marker(k: Column) -> Column:
        seg = F.try_element_at(F.filter(segments, lambda s: _contains(s["text"], k)), F.lit(1))
        return F.when(seg.isNotNull(), F.struct(F.coalesce(F.col("_first"), k).alias("point"), k.alias("keyword"), F.col("_source").alias("source"), seg["start_time"].alias("start_time"), seg["end_time"].alias("end_time"), seg["text"].alias("text")))

    at = at.withColumn("covered_points", covered).withColumn("point_time_markers", F.filter(F.transform("_hit", point_marker), lambda m: m.isNotNull()).cast(POINT_MARKER))
    coverage = F.when(F.size("_required") > 0, F.size("covered_points") / F.size("_required") * w["point_coverage"]).otherwise(F.greatest(F.col("_sim"), F.lit(0.0)) * w["point_coverage"] * 0.8)

    # risks: keywords of all risk items with repeats, in order; a category is the last item's that has the keyword
    every = [k for i in risks for k in i.keywords if k]
    category = {k: i.title for i in risks for k in i.keywords if k}
    titles = F.create_map(*(F.lit(x) for kv in category.items() for x in kv)) if category else F.create_map(F.lit(""), F.lit(""))
    found = F.filter(_strings(every), lambda k: _contains(text, k) & ~negated(text, k))

    def risk_marker(k: Column) -> Column:
        own = F.filter(segments, lambda s: _contains(s["text"], k) & ~negated(s["text"], k))
        return F.transform(own, lambda s: F.struct(k.alias("keyword"), F.try_element_at(titles, k).alias("category"), s["start_time"].alias("start_time"), s["end_time"].alias("end_time"), s["text"].alias("text"), severity(k).alias("severity")))

    at = at.withColumn("risk_keywords", found).withColumn("_statements", risk_rows(text, segments, rules))
    at = at.withColumn("risk_time_markers", F.concat(F.flatten(F.transform("risk_keywords", risk_marker)).cast(MARKER), F.col("_statements")))
    risk = F.greatest(F.lit(0.0), w["risk_detection"] - F.size("risk_keywords") * 5.0 - F.size("_statements") * 3.0)

    # keywords of the best policy or, if it has none or is too far away, of everything, empty ones included
    own = F.when(F.col("_sim") > 0.1, pick([_strings([k for k in p.keywords if k]) for p in policies], "_policy"))
    relevant = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(_strings([k for i in items for k in i.keywords]))
    at = at.withColumn("_relevant", relevant).withColumn("matched_keywords", F.filter("_relevant", lambda k: (k != "") & _contains(text, k)))
    rate = F.size("matched_keywords") / F.greatest(F.size("_relevant"), F.lit(1))

    parts = F.struct((F.col("_sim") * w["semantic_similarity"]).alias("semantic_similarity"), coverage.cast("double").alias("point_coverage"), risk.alias("risk_detection"), (rate * w["keyword_matching"]).alias("keyword_matching"))
    at = at.withColumn("components", parts).withColumn("missing_points", difference(F.col("_required"), F.col("covered_points")))
    total = F.col("components.semantic_similarity") + F.col("components.point_coverage") + F.col("components.risk_detection") + F.col("components.keyword_matching")
    at = at.withColumn("_total", total)
    return at.select(
        *[c for c in meetings.columns if c in kept or c in ("text", "segments")],
        F.bround("_total", 2).alias("total_score"),
        score_level(F.bround("_total", 2)).alias("score_level"),
        "components",
        "covered_points",
        "point_time_markers",
        "missing_points",
        "risk_keywords",
        "risk_time_markers",
        "matched_keywords",
        suggestions(F.col("_total"), F.col("missing_points"), F.col("risk_keywords")).alias("suggestions"),
    )


POINT_MARKER = "array<struct<point: string, keyword: string, source: string, start_time: double, end_time: double, text: string>>"


def live_check(segments: DataFrame, items: Sequence[Item]) -> DataFrame:
    """segments (text, start_time, end_time) plus has_risk, risk_items, covered and alerts, for batches and streams alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    risks = [k for i in items if i.group == "risk" for k in i.keywords if k]
    pairs = [(p, k) for i in items if i.group == "points" for k in i.keywords if k for p in i.points if p]
    hit = F.filter(_strings(risks), lambda k: _contains(text, k) & ~negated(text, k))
    found = F.transform(hit, lambda k: F.struct(k.alias("keyword"), severity(k).alias("severity"))).cast("array<struct<keyword: string, severity: string>>")
    said = F.filter(F.array(*(F.struct(F.lit(p).alias("point"), F.lit(k).alias("keyword")) for p, k in pairs)), lambda x: _contains(text, x["keyword"])) if pairs else F.array()
    at = segments.withColumn("risk_items", found).withColumn("covered", said.cast("array<struct<point: string, keyword: string>>"))
    high = F.transform(F.filter("risk_items", lambda r: r["severity"] == "high"), lambda r: r["keyword"])
    return at.withColumn("has_risk", F.size("risk_items") > 0).withColumn("alerts", F.when(F.size(high) > 0, F.array(F.concat(F.lit("检测到高风险内容："), F.array_join(high, ", ")))).otherwise(F.array().cast("array<string>")))


def report(scored: DataFrame) -> DataFrame:
    """One struct for each scored meeting, as a report shows it."""
    counts = F.struct(F.size("covered_points").alias("covered_points_count"), (F.size("covered_points") + F.size("missing_points")).alias("total_points_count"), F.size("risk_keywords").alias("risk_items_count"), F.size("matched_keywords").alias("matched_keywords_count"))
    return scored.withColumn("report", F.struct(F.col("total_score").alias("overall_score"), "score_level", F.col("components").alias("detailed_scores"), counts.alias("summary"), "covered_points", "missing_points", "risk_keywords", "risk_time_markers", "point_time_markers", "matched_keywords", "suggestions"))

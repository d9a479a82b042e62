"""Reports over meetings."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import score_level

LEVELS = {"excellent": "优秀", "good": "良好", "pass": "合格"}


def trend(meetings: DataFrame) -> DataFrame:
    """One row of statistics over meetings (date, score, level, duration, risks, missing): a single aggregation.

    A missing score or duration counts as 0, a level that is none of the three better ones as a fail; risks and
    missing are arrays or null. No meeting gives a row with total 0 and nulls.
    """
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)), F.lit(0)).alias(f"total_{c}")
    counts = [F.count_if(F.col("level") == v).alias(k) for k, v in LEVELS.items()]
    fail = F.count_if(~F.coalesce(F.col("level").isin(*LEVELS.values()), F.lit(False))).alias("fail")
    one = meetings.agg(
        F.count("*").alias("total"),
        F.bround(F.avg(F.coalesce("score", F.lit(0.0))), 2).alias("avg_score"),
        F.bround(F.avg(F.coalesce("duration", F.lit(0))), 0).alias("avg_duration"),
        size("risks"),
        size("missing"),
        *counts,
        fail,
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return one.withColumn("recommendations", recommendations(F.col("avg_score"), F.col("total_risks"), F.col("total_missing")))


def trend_points(meetings: DataFrame) -> DataFrame:
    """(date, score, level) in order of time."""
    return meetings.select("date", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("level", F.lit("")).alias("level")).orderBy("date")


def recommendations(avg_score: Column, risks: Column, missing: Column) -> Column:
    said = F.array(
        F.when(avg_score < 60, "整体合规评分偏低，建议加强合规培训").when(avg_score < 80, "合规评分有提升空间，建议优化传达流程"),
        F.when(risks > 5, "风险内容较多，建议加强风险预警监控"),
        F.when(missing > 10, "必传要点覆盖不足，建议完善知识库内容"),
    )
    found = F.filter(said, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("整体合规情况良好，继续保持")))


def with_reports(meetings: DataFrame, reports: DataFrame) -> DataFrame:
    """Finished meetings with their first report's lists, as `trend` takes them; one left join in place of a query each."""
    first = reports.groupBy("meeting_id").agg(F.min_by(F.struct("risk_keywords", "missing_points"), "id").alias("r"))
    own = meetings.where("status = 'finished'").join(first, F.col("id") == F.col("meeting_id"), "left")
    return own.select("date", F.col("total_score").alias("score"), F.col("score_level").alias("level"), "duration", F.col("r.risk_keywords").alias("risks"), F.col("r.missing_points").alias("missing"))


def _list(values) -> str:
    return "".join(f"<li>{escape(str(v))}</li>" for v in values or [])


def _document(title: str, body: str) -> str:
    return f'<!DOCTYPE html><html lang="zh"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def html(kind: str, row: dict) -> str:
    """A report's row as a page. kind: meeting_summary or compliance_trend."""
    if kind == "meeting_summary":
        level = score_of(row.get("total_score"))
        facts = {"时长（秒）": row.get("duration"), "参会人数": row.get("participants"), "合规得分": level}
        body = "".join(f"<p>{k}：{escape(str(v))}</p>" for k, v in facts.items()) + f"<h2>摘要</h2><p>{escape(row.get('summary') or '')}</p>"
        body += f"<h2>关键词</h2><ul>{_list(k['word'] for k in row.get('keywords') or [])}</ul><h2>议题</h2><ul>{_list(t['topic'] for t in row.get('topics') or [])}</ul><h2>建议</h2><ul>{_list(row.get('suggestions'))}</ul>"
        return _document(row.get("title") or "会议报告", body)
    if kind == "compliance_trend":
        names = {"total": "会议总数", "avg_score": "平均得分", "avg_duration": "平均时长（秒）", "total_risks": "风险内容", "total_missing": "缺失要点", "excellent": "优秀", "good": "良好", "pass": "合格", "fail": "不合格"}
        table = "".join(f"<tr><td>{v}</td><td>{escape(str(row.get(k)))}</td></tr>" for k, v in names.items())
        return _document("合规趋势报告", f"<table>{table}</table><h2>建议</h2><ul>{_list(row.get('recommendations'))}</ul>")
    return _document("未知报表类型", "")


def score_of(score: float | None) -> str:
    if score is None:
        return "—"
    name = "优秀" if score >= 90 else "良好" if score >= 75 else "合格" if score >= 60 else "不合格"
    return f"{score:g}（{name}）"


def level_histogram(rows: DataFrame, score: Column) -> DataFrame:
    """(level, n) of scores."""
    return rows.groupBy(score_level(score).alias("level")).agg(F.count("*").alias("n"))

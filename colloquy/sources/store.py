"""The tables of meetings and what may be done with them: pages, lookups, inserts, updates, upserts and deletes."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYWORD = "array<struct<word: string, frequency: bigint, score: double>>"
TOPIC = "array<struct<topic: string, score: double, keyword_hits: bigint, total_hits: bigint>>"
SENTIMENT = "struct<sentiment: string, score: double, positive: int, negative: int, positive_score: double, negative_score: double>"
MARK = "array<struct<keyword: string, category: string, start_time: double, end_time: double, text: string, severity: string>>"
POINT = "array<struct<point: string, keyword: string, source: string, start_time: double, end_time: double, text: string>>"
SCORES = "struct<semantic_similarity: double, point_coverage: double, risk_detection: double, keyword_matching: double>"
TABLES = {
    "meetings": f"id bigint, title string, date timestamp_ntz, duration bigint, status string, audio_path string, total_score double, score_level string, summary string, keywords {KEYWORD}, topics {TOPIC}, sentiment {SENTIMENT}, created_at timestamp_ntz, updated_at timestamp_ntz",
    "segments": "id bigint, meeting_id bigint, idx int, speaker string, text string, start_time double, end_time double, confidence double, language string",
    "knowledge_base": "id bigint, title string, content string, item_type string, keywords array<string>, required_points array<string>, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "compliance_reports": f"id bigint, meeting_id bigint, total_score double, score_level string, detailed_scores {SCORES}, missing_points array<string>, risk_keywords array<string>, risk_time_markers {MARK}, point_time_markers {POINT}, matched_keywords array<string>, suggestions array<string>, created_at timestamp_ntz",
    "score_weights": "id bigint, weight_name string, weight_value double, description string, updated_at timestamp_ntz",
}

# What an empty store begins with, and the lists that are served.
LANGUAGES = {"zh": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "fr": "French", "de": "German", "es": "Spanish", "ru": "Russian", "ar": "Arabic", "pt": "Portuguese"}
TOPIC_LIST = ["工作汇报", "项目讨论", "问题解决", "决策制定", "进度跟进", "计划安排", "意见交流", "培训学习"]
RISK_LIST = ["消极", "反对", "抵制", "抱怨", "不满", "拒绝", "不行", "不可能", "做不到"]
SEED_WEIGHTS = {"semantic_similarity": 40.0, "point_coverage": 30.0, "risk_detection": 20.0, "keyword_matching": 10.0}
SEED_ITEMS = [
    ("公司会议规范", "所有公司会议必须遵循公司的价值观，尊重每一位参会者的意见，保持积极的工作态度。", "policy", ["规范", "价值观", "尊重"], []),
    ("风险词汇表", "会议中应避免使用的负面或消极词汇。", "risk_keywords", RISK_LIST, []),
    ("项目例会要点", "项目例会必须包含的要点内容。", "key_points", ["进度", "问题", "计划", "目标"], ["进度汇报", "问题讨论", "下周计划", "风险说明"]),
    ("理财产品销售合规管理办法", "理财产品销售必须遵守合规要求，包括投资者适当性管理、风险测评、风险告知、禁止误导性宣传等。销售人员必须持证上岗，销售过程需录音录像。", "policy", ["风险", "销售", "投资者", "必须", "理财", "产品", "合规", "客户", "告知", "测评", "适当性"], []),
    ("金融销售风险关键词", "金融销售中禁止使用的风险词汇。", "risk_keywords", ["保本保收益", "零风险", "稳赚不赔", "绝对安全", "保证收益", "高收益无风险", "只赚不赔", "无风险"], []),
    ("理财销售必传要点", "理财产品销售必须覆盖的合规要点。", "key_points", ["风险测评", "适当性", "风险告知", "录音录像", "持证上岗", "风险等级", "承受能力", "书面确认", "风险揭示", "合规销售"], ["投资者风险测评", "风险等级匹配", "风险告知义务", "销售过程录音录像", "销售人员持证上岗", "书面确认风险揭示书"]),
]
MOST_PER_PAGE = 100
#: Seconds after which the claim of a writer that has not ended is another's to remove.
STALE = 1800


def now() -> Column:
    """The query's time, without a zone."""
    return F.current_timestamp().cast("timestamp_ntz")


def new_name(stem: Column) -> Column:
    """A name that no other row gets: the stem and a random uuid."""
    return F.concat(stem, F.lit("_"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))


class NotFound(LookupError):
    """There is no such row, or no such page."""


def page(rows: DataFrame, number: int = 1, size: int = 10, newest: str = "created_at", key: str = "id") -> DataFrame:
    """One page, newest first, ties by falling key: a top-k, not a sort of everything."""
    size = max(1, min(size, MOST_PER_PAGE))
    return rows.orderBy(F.desc(newest), F.desc(key)).offset((max(number, 1) - 1) * size).limit(size)


def total(rows: DataFrame) -> int:
    """How many rows there are on all pages."""
    return rows.count()


def latest(rows: DataFrame, *keys: str, n: int = 20) -> DataFrame:
    """The n rows with the greatest keys: a top-k."""
    return rows.orderBy(*map(F.desc, keys)).limit(n)


def where_given(rows: DataFrame, **values: object) -> DataFrame:
    """Rows equal to the values that are given; empty and None ones ask for nothing."""
    for name, value in values.items():
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which some column has the query in it, whatever the case; % and _ in it stand for anything and any one character."""
    found: Column = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(f"%{query}%")
    return rows.where(found)


def first_by(rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Of each key the row that comes first."""
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(every, order).alias("_row")).select("_row.*")


def patched(rows: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """rows with the values of patch where it has a row of the key and a value."""
    new = [c for c in patch.columns if c != key]
    given = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = rows.join(given, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in rows.columns])


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with new ones in place of those of equal keys, and the others of new added."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(rows.columns)


def report_view(meetings: DataFrame) -> DataFrame:
    """Meetings as they are shown: a score of 0 is none, a missing length is 0 and missing text and lists are empty."""
    empty = {"keywords": KEYWORD, "topics": TOPIC}
    shown = {"total_score": F.when(F.col("total_score") != 0, F.col("total_score")), "duration": F.coalesce("duration", F.lit(0)), "summary": F.coalesce("summary", F.lit(""))}
    shown |= {c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()}
    return meetings.withColumns({k: v for k, v in shown.items() if k in meetings.columns})


def envelope(rows: DataFrame, number: int, size: int, newest: str = "created_at", key: str = "id") -> DataFrame:
    """One JSON text with a page of rows and how many there are, as an answer to a request; it is bounded by MOST_PER_PAGE."""
    every, rows = total(rows), page(rows, number, size, newest, key)
    return _enveloped(rows, every, number, size)


def _enveloped(rows: DataFrame, total: int, number: int, size: int) -> DataFrame:
    every = F.collect_list(F.struct(*rows.columns))
    return rows.agg(F.to_json(F.struct(F.lit(200).alias("code"), every.alias("data"), F.lit(total).alias("total"), F.lit(number).alias("page"), F.lit(size).alias("page_size"))).alias("body"))


def decoded_lists(rows: DataFrame, **columns: str) -> DataFrame:
    """JSON text columns as typed ones; missing and empty text gives an empty list."""
    out = {}
    for name, kind in columns.items():
        value = F.from_json(F.when(F.col(name) != "", F.col(name)), kind)
        out[name] = F.coalesce(value, F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind))
    return rows.withColumns(out)


def choices(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed lists, as tables."""
    return {
        "languages": spark.createDataFrame(list(LANGUAGES.items()), "code string, name string"),
        "topics": spark.createDataFrame([(t,) for t in TOPIC_LIST], "topic string"),
        "risk_keywords": spark.createDataFrame([(t,) for t in RISK_LIST], "keyword string"),
    }


@dataclass
class Store:
    """Parquet tables below one folder; every change writes a folder with the next number, which counts once it is complete.
    Added rows are a folder by themselves; other changes write the whole table, which ends the folders before."""

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """Numbers and folders of the complete versions that make the table: the last whole one and what was added after it."""
        fs, at = self._fs(f"{self.folder}/{name}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        found = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"v(\d+)(\.added)?", n)))
        done = [(v, n) for v, n in found if fs.exists(self._fs(f"{self.folder}/{name}/{n}/_SUCCESS")[1])]
        whole = max((k for k, (_, n) in enumerate(done) if not n.endswith(".added")), default=0)
        return done[whole:]

    def _claim(self, name: str, number: int) -> bool:
        """Whether the next version's number is now this writer's: its own folder has become the claim.

        A rename to a folder that is there fails or ends below that folder, as file systems differ; so the one whose mark lies
        in the claim itself has it.
        """
        fs, claim = self._fs(f"{self.folder}/{name}/claimed-{number}")
        tag = uuid.uuid4().hex
        own = f"{self.folder}/{name}/claiming-{tag}"
        fs.create(self._fs(f"{own}/by-{tag}")[1]).close()
        try:
            fs.rename(self._fs(own)[1], claim)
        except Py4JJavaError:  # another writer's
            pass
        if fs.exists(self._fs(f"{claim.toString()}/by-{tag}")[1]):
            return True
        for rest in (own, f"{claim.toString()}/claiming-{tag}"):
            fs.delete(self._fs(rest)[1], True)
        return False

    def _change(self, name: str, make: Callable[[DataFrame], DataFrame], kind: str = "") -> None:
        """Writes what make gives of the table as its next version (with kind .added: as rows added to it).

        A writer first claims the version's number; others wait and then begin from what it has written, so that none works
        on a table that another is changing. A claim older than STALE seconds, its writer being lost, is removed. A
        version counts once it is whole.
        """
        fields = self.schema(name)
        while True:
            versions = self._versions(name)
            number = versions[-1][0] + 1 if versions else 1
            fs, claim = self._fs(f"{self.folder}/{name}/claimed-{number}")
            if fs.exists(claim) or not self._claim(name, number):
                try:
                    marks = [f.getModificationTime() / 1000 for f in fs.listStatus(claim) if f.getPath().getName().startswith("by-")]
                except Py4JJavaError:  # it has ended meanwhile
                    marks = []
                if marks and time.time() - min(marks) > STALE:
                    fs.delete(claim, True)
                time.sleep(0.2)
                continue
            try:
                last = self._versions(name)
                if (last[-1][0] + 1 if last else 1) == number:
                    rows = make(self.table(name))
                    rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{number}{kind}")
                    return
            finally:
                fs.delete(claim, True)

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(TABLES[name])

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{n}" for _, n in self._versions(name)]
        return self.spark.read.schema(self.schema(name)).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a whole new version; readers see it once it is complete."""
        self._change(name, lambda _: rows)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Adds rows in files of their own, so that the old ones are not written again; those without an id get the next
        ones, given out partition by partition without gathering them."""

        def numbered(old: DataFrame) -> DataFrame:
            top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            out = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in self.schema(name) if f.name not in rows.columns})
            out = out.withColumn("id", F.coalesce("id", F.lit(top) + 1 + F.monotonically_increasing_id()))
            return out.withColumns({c: F.coalesce(c, now()) for c in ("created_at", "updated_at") if c in out.columns})

        self._change(name, numbered, ".added")

    def get(self, name: str, key: int) -> dict:
        row = self.table(name).where(F.col("id") == key).limit(1).collect()
        if not row:
            raise NotFound(f"{name} {key}")
        return row[0].asDict(True)

    def update(self, name: str, key: int, **values: object) -> None:
        """Changes the given values of a row, none other."""
        self.get(name, key)
        own = F.col("id") == key

        def changed(rows: DataFrame) -> DataFrame:
            fields = {f.name: f.dataType for f in rows.schema}
            new = {c: F.when(own, F.lit(v).cast(fields[c])).otherwise(F.col(c)) for c, v in values.items() if c in fields and c != "id"}
            stamp = {"updated_at": F.when(own, now()).otherwise(F.col("updated_at"))} if "updated_at" in fields else {}
            return rows.withColumns(stamp | new)

        self._change(name, changed)

    def delete(self, name: str, key: int) -> None:
        self.get(name, key)
        self._change(name, lambda rows: rows.where(F.col("id") != key))

    def delete_meeting(self, key: int) -> str | None:
        """Removes a meeting with its segments and reports; returns the path of its recording, which is the caller's to remove."""
        path = self.get("meetings", key)["audio_path"]
        for name, column in (("segments", "meeting_id"), ("compliance_reports", "meeting_id"), ("meetings", "id")):
            self._change(name, lambda rows, column=column: rows.where(~F.col(column).eqNullSafe(F.lit(key))))
        return path

    def list_meetings(self, number: int = 1, size: int = 10, status: str | None = None) -> DataFrame:
        return report_view(self._page(where_given(self.table("meetings"), status=status), number, size))

    def list_items(self, number: int = 1, size: int = 10, item_type: str | None = None) -> DataFrame:
        return self._page(where_given(self.table("knowledge_base"), item_type=item_type), number, size)

    def _page(self, rows: DataFrame, number: int, size: int) -> DataFrame:
        found = page(rows, number, size)
        if number > 1 and found.isEmpty():
            raise NotFound(f"page {number}")
        return found

    def search_items(self, query: str) -> DataFrame:
        return search(self.table("knowledge_base"), query, "title", "content")

    def meeting_detail(self, key: int) -> DataFrame:
        """The meeting's row with its segments in order and its first report, or none."""
        self.get("meetings", key)
        meeting = report_view(self.table("meetings").where(F.col("id") == key))
        own = self.table("segments").where(F.col("meeting_id") == key)
        segments = own.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "text", "start_time", "end_time", "confidence", "language"))).alias("transcriptions"))
        report = first_by(self.table("compliance_reports").where(F.col("meeting_id") == key), "meeting_id")
        report = report.select(F.col("meeting_id").alias("_m"), F.struct(*report.columns).alias("compliance_report"))
        return meeting.join(segments, F.col("id") == F.col("meeting_id"), "left").drop("meeting_id").join(report, F.col("id") == F.col("_m"), "left").drop("_m")

    def report(self, meeting: int) -> dict:
        row = first_by(self.table("compliance_reports").where(F.col("meeting_id") == meeting), "meeting_id").collect()
        if not row:
            raise NotFound(f"report of meeting {meeting}")
        return row[0].asDict(True)

    def weights(self) -> dict[str, float]:
        """The stored weights, or the defaults if there are none."""
        return {r["weight_name"]: r["weight_value"] for r in self.table("score_weights").limit(1000).collect()} or dict(SEED_WEIGHTS)

    def set_weights(self, values: Mapping[str, float]) -> None:
        new = self.spark.createDataFrame([(None, k, float(v)) for k, v in values.items()], "id bigint, weight_name string, weight_value double")

        def merged(old: DataFrame) -> DataFrame:
            ids = old.select(F.col("weight_name").alias("_n"), F.col("id").alias("_id"))
            top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            numbered = new.join(ids, F.col("weight_name") == F.col("_n"), "left").select(F.coalesce("_id", F.lit(top) + F.row_number().over(Window.orderBy("weight_name"))).alias("id"), "weight_name", "weight_value")
            return upserted(old, numbered, "weight_name")

        self._change("score_weights", merged)

    def seed(self) -> None:
        """Puts the defaults in where a table is empty."""
        if self.table("score_weights").isEmpty():
            self.set_weights(SEED_WEIGHTS)
        if self.table("knowledge_base").isEmpty():
            rows = [(k + 1, t, c, kind, w, p, "active") for k, (t, c, kind, w, p) in enumerate(SEED_ITEMS)]
            self.insert("knowledge_base", self.spark.createDataFrame(rows, "id bigint, title string, content string, item_type string, keywords array<string>, required_points array<string>, status string"))

    def diagnose(self) -> dict[str, dict]:
        """For each table its columns, its number of rows and its last twenty rows."""
        return {n: {"columns": self.table(n).dtypes, "count": self.table(n).count(), "last": [r.asDict(True) for r in latest(self.table(n), "id").collect()]} for n in TABLES}

"""More of the library's queries: operators that the queries over whole tables don't reach, with their SQL.

What an operator does to Chinese text, files, recordings or a store is asked of a few rows that are given here; the
SQL then has the rows that the rules give. What can be asked of a test table is.
"""

from __future__ import annotations

import io
import re
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicons as L
from .functions import rules as R
from .functions import text as T
from .operators import audio, compliance, diarize, keywords, lexicon, sentences, sentiment, timeline
from .plans import analyze, reports, summary
from .queries import micros, query, read
from .sources import files, store
from .sources.shared import folder
from .streaming import live, sessions


def _values(rows: list[tuple], names: str) -> str:
    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


# ---- the store


_STEPS = [
    ("kept after a second seed", "6"), ("weight of points", "30.0"), ("weights after a change", "25.0 5"), ("get", "b processing"), ("detail", "c 2 50.0"), ("first report", "50.0"),
    ("finished", "1"), ("score of 0", "None"), ("no such row", "NotFound"), ("no such page", "NotFound"), ("most on a page", "100"), ("after the delete", "1 1 0"), ("last of the diagnosis", "2"), ("created and updated", "True True"), ("names differ", "True"), ("found items", "2"),
]


@query(_values(_STEPS, "step, said"))
def store_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Seed, insert, get, update, upsert, detail, pages, delete with what belongs to it, and diagnosis of a store."""
    s, said = store.Store(spark, folder(spark, "store")), {}

    def fails(f) -> str:
        try:
            f()
        except store.NotFound as e:
            return type(e).__name__
        return "no"

    s.seed()
    s.seed()
    said["kept after a second seed"] = s.table("knowledge_base").count()
    said["weight of points"] = s.weights()["point_coverage"]
    s.set_weights({"point_coverage": 25, "extra": 1})
    said["weights after a change"] = f"{s.weights()['point_coverage']} {len(s.weights())}"
    s.insert("meetings", spark.createDataFrame([("a", "finished", 0.0), ("b", "processing", 80.0)], "title string, status string, total_score double"))
    ids = {r["title"]: r["id"] for r in s.table("meetings").collect()}
    b = s.get("meetings", ids["b"])
    said["get"] = f"{b['title']} {b['status']}"
    s.update("meetings", ids["a"], title="c")
    s.insert("segments", spark.createDataFrame([(ids["a"], 0, "A", "t"), (ids["a"], 1, "B", "u"), (ids["b"], 0, "B", "u")], "meeting_id long, idx int, speaker string, text string"))
    s.insert("compliance_reports", spark.createDataFrame([(1, ids["a"], 50.0), (2, ids["a"], 70.0)], "id long, meeting_id long, total_score double"))
    x = s.meeting_detail(ids["a"]).first()
    said["detail"] = f"{x['title']} {len(x['transcriptions'])} {x['compliance_report']['total_score']}"
    said["first report"] = s.report(ids["a"])["total_score"]
    said["finished"] = s.list_meetings(status="finished").count()
    said["score of 0"] = s.list_meetings(status="finished").first()["total_score"]
    said["created and updated"] = f"{x['created_at'] is not None} {x['updated_at'] >= x['created_at']}"
    said["no such row"], said["no such page"] = fails(lambda: s.get("meetings", -1)), fails(lambda: s.list_meetings(9))
    said["most on a page"] = store.page(spark.range(500).withColumn("created_at", F.col("id")), 1, 1000).count()
    s.delete_meeting(ids["a"])
    said["after the delete"] = f"{s.table('meetings').count()} {s.table('segments').count()} {s.table('compliance_reports').count()}"
    said["last of the diagnosis"] = len([n for n, v in s.diagnose().items() if n in ("meetings", "segments") and v["count"] == len(v["last"]) == 1])
    names = spark.range(50).select(store.new_name(F.lit("a"))).distinct()
    said["names differ"] = names.count() == 50
    said["found items"] = s.search_items("理财").count()
    return spark.createDataFrame([(k, str(said[k])) for k, _ in _STEPS], "step string, said string")


@query("SELECT count(*) AS total, 2 AS page, 10 AS page_size, 200 AS code, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 10)) AS keys FROM orders WHERE o_orderstatus = 'F'")
def page_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The answer to a request for the second page, read back from its JSON."""
    own = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    body = store.envelope(own, 2, 10, "o_orderdate", "o_orderkey")
    said = F.from_json("body", "code int, data array<struct<o_orderkey: bigint>>, total bigint, page int, page_size int")
    out = body.select(said.alias("x"))
    return out.select("x.total", "x.page", "x.page_size", "x.code", F.array_join(F.transform("x.data", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


@query("SELECT 'languages' AS list, 10 AS n UNION ALL SELECT 'topics', 8 UNION ALL SELECT 'risk_keywords', 9")
def served_lists(spark: SparkSession, d: str) -> DataFrame:
    parts = [t.agg(F.lit(name).alias("list"), F.count("*").cast("int").alias("n")) for name, t in store.choices(spark).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey, l.l_partkey AS part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 10000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def trend_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each finished meeting with its first report's lists, by one join."""
    meetings = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open").alias("status"), F.col("o_orderkey").alias("date"), F.lit(1.0).alias("total_score"), F.lit("").alias("score_level"), F.lit(1).alias("duration"))
    found = read(spark, d, "lineitem").select((F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("meeting_id"), F.array("l_partkey").alias("risk_keywords"), F.array("l_partkey").alias("missing_points"))
    return reports.with_reports(meetings, found).select(F.col("date").alias("o_orderkey"), F.col("risks")[0].alias("part"))


@query(_values([("forbidden", "risk"), ("key_points", "points"), ("meeting_spirit", "policy"), ("other", None), ("policy", "policy"), ("required", "points"), ("risk_keywords", "risk")], "title, kind"))
def item_groups(spark: SparkSession, d: str) -> DataFrame:
    """What an item's type makes it; items that are not active have no part."""
    kinds = [*compliance.GROUPS, "other"]
    rows = [(k, x, "c", x, ["w"], None, "active") for k, x in enumerate(kinds)] + [(99, "off", "c", "policy", [], [], "inactive")]
    kb = spark.createDataFrame(rows, "id long, title string, content string, item_type string, keywords array<string>, required_points array<string>, status string")
    return spark.createDataFrame([(i.title, i.group) for i in compliance.active_items(kb)], "title string, kind string")


@query(_values([(1, True), (2, True), (3, True), (4, True)], "id, ok"))
def report_html(spark: SparkSession, d: str) -> DataFrame:
    made = [reports.html("meeting_summary", {"title": "<b>", "total_score": 95.0}), reports.html("compliance_trend", {"avg_score": 58.33}), reports.html("x", {}), reports.html("meeting_summary", {})]
    ok = ["&lt;b&gt;" in made[0] and "<b>" not in made[0], "58.33" in made[1], "未知" in made[2], made[3].startswith("<!DOCTYPE html>")]
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(ok)], "id int, ok boolean")


# ---- files and recordings


def _put(spark: SparkSession, folder: str, name: str, raw: bytes) -> None:
    """A file in any file system that the session knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(raw)
    out.close()


def _docx(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query(_values([("a.txt", "第一章总则", "必须按时参加会议|做好记录工作"), ("b.docx", "标题一", "按时完成工作"), ("c.docx", "c", ""), ("d.pdf", "readbythecaller", ""), ("e.doc", "e", ""), ("f.txt", "plain", "")], "name, title, points"))
def policy_files(spark: SparkSession, d: str) -> DataFrame:
    """Policies of text files in several encodings and forms: title and required points."""
    where = folder(spark, "texts")
    texts = {"a.txt": "第一章 总则\n1、必须按时参加会议\n- 做好记录工作\n".encode("gbk"), "b.docx": _docx("标题一", "2. 按时完成工作"), "c.docx": b"broken", "d.pdf": b"%PDF", "e.doc": b"\xd0\xcf", "f.txt": "plain".encode("utf-16")}
    for name, raw in texts.items():
        _put(spark, where, name, raw)
    found = files.policies(files.read_texts(spark, where, {"pdf": lambda raw: "read by the caller"}))
    return found.select("name", "title", F.array_join("required_points", "|").alias("points"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w), c AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM u GROUP BY doc_id, word), t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY n DESC, first) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 5 GROUP BY doc_id) SELECT doc_id, coalesce(top, '') AS top FROM documents LEFT JOIN t USING (doc_id) WHERE text IS NOT NULL")
def policy_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words of each text, as a policy's keywords are found."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(files.most_frequent(words, 5), " ").alias("top"))


@query(_values([("a.wav", 16000, 0.5), ("b.wav", 16000, 0.25), ("c.wav", 8000, 0.5), ("d.wav", 16000, 0.125)], "name, n, peak"))
def recordings(spark: SparkSession, d: str) -> DataFrame:
    """WAV files of 8, 16, 24 and 32 bits, one and two channels, at one rate; files that are too small or no recordings stay out."""
    import wave

    where = folder(spark, "wav")

    def wav(data: bytes, width: int, channels: int = 1, rate: int = 16000) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((channels, width, rate, 0, "NONE", ""))
            w.writeframes(data)
        return out.getvalue()

    square = np.tile([0.5, -0.5], 8000)
    three = np.tile([0.125, -0.125], 8000)
    _put(spark, where, "a.wav", wav((square * 2**31).astype("<i4").tobytes(), 4))
    _put(spark, where, "b.wav", wav((np.repeat(square, 2) * np.tile([1, 0], 16000) * 32768).astype("<i2").tobytes(), 2, 2))
    _put(spark, where, "c.wav", wav(np.full(8000, 192, np.uint8).tobytes(), 1))
    _put(spark, where, "d.wav", wav(b"".join(int(x * 2**23).to_bytes(3, "little", signed=True) for x in three), 3))
    _put(spark, where, "small.wav", b"RIFF")
    _put(spark, where, "e.txt", b"x" * 2000)
    out = files.read_recordings(spark, where)
    peak = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    return out.select(files.file_name(F.col("path")).alias("name"), F.size("samples").alias("n"), F.round(peak.cast("double"), 4).alias("peak"))


@query("SELECT user_id, count(*) * 4 AS samples, max(value) <= 50000 AS ok FROM events GROUP BY user_id")
def pcm_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each session's base64 chunks of samples as one WAV file, whose size tells how many samples it has."""
    e = read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(F.lit("data:audio/pcm;base64,"), F.base64(F.lit(b"\x00\x01\x02\x03\x04\x05\x06\x07"))).alias("said"))
    out = files.recordings_of(e.select("session_id", "seq", files.from_base64(F.col("said")).alias("pcm")))
    size = (F.octet_length("wav") - 44) / 2
    return out.select(F.col("session_id").alias("user_id"), size.cast("long").alias("samples"), (size > 0).alias("ok"))


@query("SELECT doc_id, regexp_extract(source, '\\.([^./]+)$', 1) AS kind, CASE WHEN contains(source, '/') THEN regexp_extract(source, '([^/]*)$', 1) ELSE source END AS name FROM documents WHERE source IS NOT NULL")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", files.extension(F.col("source")).alias("kind"), files.file_name(F.col("source")).alias("name"))


# ---- signals


def _tone(hz: float, seconds: float, level: float = 0.5) -> np.ndarray:
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * 16000)) / 16000)


def _signals(spark: SparkSession) -> DataFrame:
    noise = np.random.default_rng(5).normal(0, 0.02, 32000)
    rows = {"low": _tone(20, 2), "mid": _tone(1000, 2), "noisy": _tone(440, 2) + noise, "noise": noise, "silent": np.zeros(32000)}
    return spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], "name string, samples array<double>")


def _rms(c: str):
    middle = F.slice(c, 4000, 24000)
    return F.sqrt(F.aggregate(middle, F.lit(0.0), lambda s, x: s + x * x) / F.size(middle))


@query(_values([("band pass", "low", True), ("band pass", "mid", True), ("noise off", "noise", True), ("noise off", "mid", True), ("enhanced", "noisy", True), ("normal", "mid", True), ("normal", "silent", True), ("echo", "mid", True), ("emphasis", "low", True), ("all", "noisy", True)], "step, name, ok"))
def signal_steps(spark: SparkSession, d: str) -> DataFrame:
    """Each step of the preprocessing on tones and noise: what has to go goes, what has to stay stays."""
    s = _signals(spark).withColumn("before", _rms("samples"))
    low, mid, noise, noisy, silent = (s.where(F.col("name") == x) for x in ("low", "mid", "noise", "noisy", "silent"))
    after = lambda rows, step: audio.applied(rows, step).withColumn("samples", F.col("samples").cast("array<double>")).withColumn("after", _rms("samples"))
    ratio = F.col("after") / F.col("before")
    found = [
        ("band pass", after(low, audio.band_pass), ratio < 0.1), ("band pass", after(mid, audio.band_pass), F.abs(ratio - 1) < 0.02),
        ("noise off", after(noise, audio.subtract_noise), ratio < 0.5), ("noise off", after(mid, audio.subtract_noise), F.col("after") < F.col("before")),
        ("enhanced", after(noisy, audio.enhance), ratio.between(0.2, 1.1)), ("normal", after(mid, audio.normalise), F.abs(20 * F.log10("after") + 20) < 0.1),
        ("normal", after(silent, audio.normalise), F.col("after") == 0), ("echo", after(mid, audio.cancel_echo), ratio < 0.3),
        ("emphasis", after(low, audio.pre_emphasis), ratio < 0.1), ("all", after(noisy, audio.preprocess), F.col("after").between(0.001, 0.12)),
    ]
    out = [rows.select(F.lit(step).alias("step"), "name", ok.alias("ok")) for step, rows, ok in found]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query(_values([("low", 63, 76, True), ("mid", 63, 76, True), ("noise", 63, 76, True), ("noisy", 63, 76, True), ("silent", 63, 76, True)], "name, frames, width, ok"))
def signal_frames(spark: SparkSession, d: str) -> DataFrame:
    """Features of every frame: how many, how wide, and a level that is the signal's own."""
    s = _signals(spark)
    f = audio.frames_of(s, "name").groupBy("name").agg(F.count("*").cast("int").alias("frames"), F.max(F.size("features")).alias("width"), F.median("rms").alias("level"))
    return f.join(s.select("name", _rms("samples").alias("own")), "name").select("name", "frames", "width", (F.abs(F.col("level") - F.col("own")) < 0.01).alias("ok"))


@query("SELECT user_id, round_even(10 * log10((var_pop(value) + 1e-10) / (var_pop(value / 2) + 1e-10)), 1) AS reduction, 0.0 AS snr FROM events GROUP BY user_id")
def signal_quality(spark: SparkSession, d: str) -> DataFrame:
    """How much quieter half a signal is, in decibels."""
    rows = read(spark, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("before")).withColumn("after", F.transform("before", lambda x: x / 2))
    q = F.col("quality")
    return audio.quality_report(rows).select("user_id", F.bround(q["noise_reduction_db"], 1).alias("reduction"), (q["snr_before"] + q["snr_after"]).cast("decimal(2,1)").alias("snr"))


# ---- voices


_STANDARD = "WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT {key}i, avg(x) AS m, {deviation}(x) AS d FROM f GROUP BY ALL) SELECT vec_id, round(sum(abs((x - m) / CASE WHEN d > 0 THEN d ELSE 1 END)), 4) AS total FROM f JOIN s USING ({key}i) GROUP BY vec_id"


def _sizes(df: DataFrame) -> DataFrame:
    values = F.transform("scaled", lambda x: F.abs(x))
    return df.select("vec_id", F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(_STANDARD.format(key="", deviation="stddev_samp"))
def standardised_frames(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(diarize.standardised(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding"))


@query(_STANDARD.format(key="label, ", deviation="stddev_pop"))
def standardised_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Each label's vectors scaled by themselves alone."""
    return _sizes(diarize.standardised(read(spark, d, "embeddings"), "embedding", "label"))


def _planted(embedding: Column, voice: Column, voices: Column | int) -> Column:
    """A vector with a voice in it: 4 more in every component of that voice."""
    return F.transform(embedding, lambda x, i: x.cast("double") + F.when(i % voices == voice, 4.0).otherwise(0.0))


def _numbered(spark: SparkSession, d: str, key: Column) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("recording", key)
    return e.withColumn("i", (F.row_number().over(Window.partitionBy("recording").orderBy("vec_id")) - 1).cast("long"))


@query("SELECT vec_id, method, ((row_number() OVER (PARTITION BY label, method ORDER BY vec_id) - 1) // 5 % 3)::INT AS voice FROM embeddings, (VALUES ('spectral'), ('hierarchical'), ('kmeans')) m(method)")
def voices_apart(spark: SparkSession, d: str) -> DataFrame:
    """Three voices planted in every label's vectors, five vectors in turn: each method tells them apart in each label."""
    own = _numbered(spark, d, F.col("label"))
    points = own.select("recording", "i", "vec_id", _planted(F.col("embedding"), F.floor(F.col("i") / 5) % 3, 3).alias("scaled"))
    found = [diarize.clustered(points, "recording", 3, method).select("vec_id", F.lit(method).alias("method"), F.col("label").cast("int").alias("voice")) for method in ("spectral", "hierarchical", "kmeans")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT label % 2 AS recording, CASE WHEN count(*) < 100 THEN 2 ELSE 2 + label % 2 END AS speakers, least(count(*) // 10, 2 + label % 2)::INT AS fast FROM embeddings GROUP BY label % 2")
def number_of_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Two voices planted in the even labels' vectors, three in the odd ones': both estimates find that."""
    own = _numbered(spark, d, F.col("label") % 2)
    voices = F.col("recording") + 2
    points = own.select("recording", "i", _planted(F.slice("embedding", 1, 6), F.col("i") % voices, voices).alias("scaled"))
    told, fast = diarize.speakers_of(points, "recording"), diarize.speakers_of(points, "recording", tell=diarize.voices.speakers_fast)
    return told.join(fast.withColumnRenamed("speakers", "fast"), "recording")


@query("SELECT label AS recording, (row_number() OVER w - 1)::INT AS idx, round((row_number() OVER w - 1) * 0.64, 2) AS start, round(row_number() OVER w * 0.64, 2) AS \"end\", 'SPEAKER_0' || (row_number() OVER w - 1) % 3 AS speaker FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def diarized_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Segments of recordings in which three voices take turns: each vector is a turn of 20 frames, of which every fifth is quiet."""
    turns = _numbered(spark, d, F.col("label"))
    length = F.count("*").over(Window.partitionBy("recording")) * 20 * 512 / 16000
    each = turns.withColumn("duration", length).withColumn("voice", F.col("i") % 3).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19))))
    loud = F.when(F.col("r") % 5 == 2, F.lit(0.1)).otherwise(1 + F.col("r") / 1000)
    varied = F.concat(F.slice("embedding", 3 * F.col("r") + 1, F.lit(64)), F.slice("embedding", F.lit(1), 3 * F.col("r")))  # turned, so that no two frames are alike
    frames = each.select("recording", (F.col("i") * 20 + F.col("r")).alias("i"), _planted(varied, F.col("voice"), 3).alias("features"), loud.alias("rms"), "duration")
    return diarize.diarize(frames, "recording", speakers=3)


@query("SELECT user_id, count(*) FILTER (value > p) AS above FROM (SELECT user_id, value, quantile_cont(value, 0.2) OVER (PARTITION BY user_id) AS p FROM events) GROUP BY user_id")
def voiced_frames(spark: SparkSession, d: str) -> DataFrame:
    return diarize.voiced(read(spark, d, "events"), "user_id", "value").groupBy("user_id").agg(F.count_if("voiced").alias("above"))


# ---- rewrite rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The rules' own words without repeats (which only back-references find), to be planted at the beginning and end of texts.
_PLANTED = sorted({b for name in R.NAMED for p, _ in R.NAMED[name]() if (b := re.sub(r"\\u....|[\^\\\[\](){}.*+?|$\d\-]|s(?=\*|$)", "", p)) and not re.search(r"(..+)\1", b)})


def _rules_sql(name: str) -> str:
    """The rules one after the other in SQL; those that look for repeats are left out, as its patterns have no back-references."""
    text = "planted"
    for pattern, replacement in R.NAMED[name]():
        if "\\1" not in pattern:
            text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"
    return text


def _planted_sql(name: str) -> str:
    words = ", ".join(map(_quoted, _PLANTED))
    return f"""WITH w AS (SELECT [{words}] AS w),
p AS (SELECT conv_id, turn, w[1 + (conv_id * 31 + turn * 7) % {len(_PLANTED)}] || '，' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || '，' || w[1 + (conv_id * 17 + turn * 5) % {len(_PLANTED)}] AS planted FROM conversations, w)
SELECT conv_id, turn, regexp_replace({_rules_sql(name)}, '^\\s+|\\s+$', '', 'g') AS said FROM p"""


def _told(spark: SparkSession, d: str, name: str) -> DataFrame:
    words = F.array(*map(F.lit, _PLANTED))
    at = lambda a, b: F.element_at(words, (1 + (F.col("conv_id") * a + F.col("turn") * b) % len(_PLANTED)).cast("int"))
    text = F.concat(at(31, 7), F.lit("，"), F.regexp_replace(F.lower("text"), "[^a-z]+", " "), F.lit("，"), at(17, 5))
    return read(spark, d, "conversations").select("conv_id", "turn", R.rewritten(text, name).alias("said"))


@query(_planted_sql("narrated"))
def narrated_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn, with the rules' own words planted at both ends, as a report tells it."""
    return _told(spark, d, "narrated")


@query(_planted_sql("tidied"))
def tidied_turns(spark: SparkSession, d: str) -> DataFrame:
    """The same turns without spoken openings and endings, repeats and filler."""
    return _told(spark, d, "tidied")


# ---- sessions


@query("""
WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id::VARCHAR AS session, seq, seq % 40 AS r, seq % 40 - 3 AS k, n FROM m),
o AS (
  SELECT session, seq, 'error' AS event, NULL::DOUBLE AS s, NULL::DOUBLE AS e, 0 AS chunks FROM r WHERE r < 3 OR r > 35
  UNION ALL SELECT session, seq, 'started', 0, 0, 0 FROM r WHERE r = 3
  UNION ALL SELECT session, seq, 'piece', k - 10, k, 10 FROM r WHERE r BETWEEN 4 AND 34 AND k % 10 = 0
  UNION ALL SELECT session, seq, 'piece', 30, 31, 1 FROM r WHERE r = 35
  UNION ALL SELECT session, seq, 'stopped', 0, 31, 0 FROM r WHERE r = 35
  UNION ALL SELECT session, seq, 'piece', k - k % 10, k, k % 10 FROM r WHERE seq = n - 1 AND r BETWEEN 4 AND 34 AND k % 10 > 0
  UNION ALL SELECT session, seq, 'expired', 0, k, 0 FROM r WHERE seq = n - 1 AND r BETWEEN 3 AND 34)
SELECT session, seq, event, s AS start, e AS "end", chunks::INT AS chunks FROM o""")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as messages of which the 4th of forty starts a session and the 36th stops it; each message comes twice."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), (F.row_number().over(own) - 1).cast("long").alias("seq"))
    place = F.col("seq") % 40
    rows = rows.withColumn("kind", F.when(place == 3, "start").when(place == 35, "stop").otherwise("chunk")).withColumn("level", F.lit(0.1)).withColumn("seconds", F.lit(1.0))
    said = sessions.sessions_in(rows.unionByName(rows), pause=0.0, longest=10.0)
    return said.select("session", "seq", "event", "start", "end", F.size("chunks").alias("chunks"))


# ---- words without spaces


def _signs(c: Column) -> Column:
    """A text written without spaces in 26 signs: its letters, each as a sign, and stops."""
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z.!?]", ""), "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26)))


_SIGNS = f"translate(regexp_replace(lower(text), '[^a-z.!?]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{''.join(chr(0x4E00 + i) for i in range(26))}')"


@query(f"""
WITH r AS (SELECT unnest(regexp_extract_all({_SIGNS}, '[{chr(0x4E00)}-{chr(0x4E19)}]+')) AS run FROM conversations),
g AS (SELECT substring(run, i, k) AS gram, count(*) AS n FROM r, range(1, 5) AS ks(k), LATERAL (SELECT unnest(range(1, length(run) - k + 2)) AS i) GROUP BY ALL),
t AS (SELECT sum(n) AS total FROM g WHERE length(gram) = 1),
w AS (SELECT gram AS word, n FROM g WHERE n >= 20 AND length(gram) IN (2, 3)),
c AS (SELECT w.word, w.n, max(a.n::DOUBLE * b.n) AS chance FROM w, range(1, 3) AS cut(k) JOIN g a ON a.gram = substring(w.word, 1, k) JOIN g b ON b.gram = substring(w.word, k + 1) WHERE k < length(w.word) GROUP BY ALL),
e AS (SELECT side, word, sum(n) AS met, sum(n * ln(n)) AS s FROM (SELECT 'b' AS side, substring(gram, 1, length(gram) - 1) AS word, n FROM g WHERE length(gram) > 1 UNION ALL SELECT 'a', substring(gram, 2), n FROM g WHERE length(gram) > 1) GROUP BY ALL),
v AS (SELECT c.word, min(ln(c.n) - (coalesce(s, 0) + CASE WHEN c.n > coalesce(met, 0) THEN (c.n - coalesce(met, 0)) * ln(c.n - coalesce(met, 0)) ELSE 0 END) / c.n) AS variety FROM c CROSS JOIN (VALUES ('a'), ('b')) AS x(side) LEFT JOIN e USING (side, word) GROUP BY c.word)
SELECT word, n, round(n * total / chance, 4) AS together, round(variety, 4) AS variety FROM c JOIN v USING (word), t WHERE n * total / chance >= 3 AND variety >= 0.8""")
def corpus_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of up to three signs that the turns of all conversations, written without spaces, have of their own."""
    rows = read(spark, d, "conversations").select(_signs(F.col("text")).alias("text"))
    found = lexicon.learned_words(rows, longest=3, least=20, together=3.0, variety=0.8)
    return found.select("word", "n", F.round("together", 4).alias("together"), F.round("variety", 4).alias("variety"))


@query()
def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every turn, written without spaces, cut along the most probable path of the corpus's words, with tags."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", _signs(F.col("text")).alias("text"))
    tags = {chr(0x4E00 + a) + chr(0x4E00 + b): "v" if a % 2 else "n" for a in range(26) for b in range(26)}
    model = lexicon.learn(rows, tags, longest=3, least=20, together=3.0, variety=0.8)
    return rows.select("conv_id", "turn", F.array_join(F.transform(lexicon.path_tagged(F.col("text"), model), lambda x: F.concat(x["word"], F.lit("/"), x["tag"])), " ").alias("words"))


# ---- texts


@query("SELECT event_id, printf('%02d:%02d.000', (value * 10)::BIGINT // 60, (value * 10)::BIGINT % 60) AS clock, greatest(5.0, least(value, 20.0)) AS held, lower(event_type) = 'true' AS said FROM (SELECT event_id, floor(value) AS value, event_type FROM events)")
def small_functions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("value", F.floor("value").cast("double"))
    return e.select("event_id", T.clock(F.col("value") * 10).alias("clock"), T.clamp(F.col("value"), 5.0, 20.0).alias("held"), T.flag(F.col("event_type")).alias("said"))


@query(
    """WITH t AS (SELECT conv_id, turn, text, list_distinct(string_split(text, '')) AS c, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM conversations WHERE text <> '')
SELECT a.conv_id, a.turn, round(len(list_intersect(a.c, b.c)) / greatest(len(a.c), 1), 6) AS characters,
  round(CASE WHEN least(len(a.w), len(b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) ELSE 0 END, 6) AS words
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
)
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Characters and words that a turn shares with the next."""
    t = read(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", "text", T.words(F.col("text")).alias("w"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"), F.col("w").alias("v"))
    both = t.join(after, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(T.character_share(F.col("text"), F.col("next")), 6).alias("characters"), F.round(T.overlap_share(F.col("w"), F.col("v")), 6).alias("words"))


@query("SELECT conv_id, turn, (turn % 40) + 2 <= 30 AS negated FROM conversations")
def negation_reach(spark: SparkSession, d: str) -> DataFrame:
    """A word takes a risk away from up to 30 characters before it."""
    text = F.concat(F.lit("禁止"), F.repeat(F.lit("好"), (F.col("turn") % 40).cast("int")), F.lit("保本"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.negated(text, F.lit("保本")).alias("negated"))


_CLAIMS = "regexp_extract_all(text, 'tion[a-z]+|ation')"


@query(f"WITH m AS (SELECT conv_id, turn, unnest({_CLAIMS}) AS keyword FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM m GROUP BY conv_id) SELECT m.conv_id, m.turn, m.keyword, n.n * count(*) AS rows FROM m JOIN n ON m.conv_id = n.conv_id GROUP BY m.conv_id, m.turn, m.keyword, n.n")
def risk_statements(spark: SparkSession, d: str) -> DataFrame:
    """Every match of a rule in a segment, once for each match in the whole text."""
    c = read(spark, d, "conversations")
    segments = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("speaker"), "text", F.col("turn").cast("double").alias("start_time"), F.col("turn").cast("double").alias("end_time"))
    rows = compliance.risk_rows(F.col("text"), F.col("segments"), [("tion[a-z]+|ation", "c", "high")])
    each = analyze.meeting_texts(segments).select("meeting_id", F.explode(rows).alias("r"))
    return each.groupBy(F.col("meeting_id").alias("conv_id"), F.col("r.start_time").cast("int").alias("turn"), F.col("r.keyword").alias("keyword")).agg(F.count("*").alias("rows"))


_KEYS, _RISKS = ["ation", "zzz"], ["only", "worthless"]


def _contains_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    f"""WITH m AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text, max(turn) + 1 AS duration, count(DISTINCT coalesce(role, 'unknown')) AS participants FROM conversations GROUP BY conv_id),
f AS (SELECT *, list_filter({_contains_sql(_KEYS)}, lambda k: contains(lower(text), k)) AS keys, list_filter({_contains_sql(_RISKS)}, lambda k: contains(lower(text), k)) AS risks FROM m),
r AS (SELECT conv_id, count(*) AS n FROM conversations, (SELECT unnest({_contains_sql(_RISKS)}) AS k) WHERE contains(lower(text), k) GROUP BY conv_id),
p AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE contains(lower(text), 'ation') GROUP BY conv_id),
t AS (SELECT f.*, CASE WHEN len(keys) > 0 THEN 30.0 ELSE 0.0 END + (20.0 - 5 * len(risks)) + 10.0 * (len(keys) + len(risks)) / 4 AS total, coalesce(r.n, 0) AS marks, p.first FROM f LEFT JOIN r USING (conv_id) LEFT JOIN p USING (conv_id))
SELECT conv_id, duration::INT AS duration, participants::INT AS participants, round(total, 2)::DOUBLE AS total, '不合格' AS level, array_to_string(risks, ',') AS risks, marks::INT AS marks, CASE WHEN contains(text, 'ation') OR contains(lower(text), 'ation') THEN first::DOUBLE END AS first_point,
  CASE WHEN len(keys) > 0 THEN 'a,b' ELSE '' END AS covered, len(keys) + len(risks) AS matched,
  '会议内容与政策要求差距较大，建议重新传达' || CASE WHEN len(risks) > 0 THEN '|发现风险内容：' || array_to_string(risks, ', ') || '，请核查' ELSE '' END AS suggestions FROM t"""
)
def meeting_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation scored as a meeting: points with the first segment that has them, risks with all, suggestions."""
    c = read(spark, d, "conversations")
    segments = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("speaker"), "text", F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1).cast("double").alias("end_time"))
    items = [compliance.Item("p", "", "points", _KEYS, ["a", "b"]), compliance.Item("r", "", "risk", _RISKS)]
    out = compliance.report(compliance.score(analyze.meeting_texts(segments), items, rules=[]))
    first = F.array_min(F.transform(F.filter("point_time_markers", lambda m: m["keyword"] == "ation"), lambda m: m["start_time"]))
    return out.select(
        F.col("meeting_id").alias("conv_id"), "duration", "participants", F.col("report.overall_score").alias("total"), F.col("score_level").alias("level"), F.array_join("risk_keywords", ",").alias("risks"),
        F.size("risk_time_markers").alias("marks"), first.alias("first_point"), F.array_join("covered_points", ",").alias("covered"), F.col("report.summary.matched_keywords_count").cast("long").alias("matched"), F.array_join("suggestions", "|").alias("suggestions"),
    )


@query("SELECT conv_id, 0.0::DOUBLE AS total, '不合格' AS level, 0 AS parts, '知识库为空，请先添加合规检查规则' AS said FROM conversations GROUP BY conv_id")
def no_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation scored where the knowledge base is empty."""
    c = read(spark, d, "conversations")
    segments = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("speaker"), "text", F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1).cast("double").alias("end_time"))
    out = compliance.score(analyze.meeting_texts(segments), [])
    parts = sum((F.size(x) for x in ("covered_points", "missing_points", "risk_keywords", "risk_time_markers", "matched_keywords")), F.lit(0))
    return out.select(F.col("meeting_id").alias("conv_id"), F.col("total_score").alias("total"), F.col("score_level").alias("level"), parts.alias("parts"), F.array_join("suggestions", "|").alias("said"))


@query(_values([(1, 40.0, 30.0, 20.0, 10.0, 100.0, "x,y", ""), (2, 8.0, 0.0, 20.0, 0.0, 28.0, "", "x,y"), (3, 0.0, 30.0, 20.0, 2.5, 52.5, "u", ""), (4, 0.0, 0.0, 20.0, 0.0, 20.0, "", "")], "id, semantic, coverage, risk, matched, total, covered, missing"))
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best policy decides by similarity, and its title which points are asked for; without one the keywords decide.

    1 is the first policy's own text; 2 shares two of its ten words, so that its points are asked for and missing, and
    none of its keywords is there; 3 is like no policy, but has a keyword of the second item, one of four of all items; 4 has nothing.
    """
    items = [
        compliance.Item("lending rules", "alpha beta gamma delta", "policy", ["alpha"]),
        compliance.Item("travel", "omega psi chi", "policy", ["omega"]),
        compliance.Item("lending rules points", "", "points", ["gamma"], ["x", "y"]),
        compliance.Item("other", "", "points", ["sigma"], ["u"]),
    ]
    rows = [(1, "alpha beta gamma delta", None), (2, "beta delta one two three four five six", None), (3, "sigma", None), (4, "nothing here", None)]
    out = compliance.score(spark.createDataFrame(rows, f"id int, text string, segments {compliance.SEGMENTS}"), items)
    c = F.col("components")
    return out.select("id", c["semantic_similarity"].alias("semantic"), c["point_coverage"].alias("coverage"), c["risk_detection"].alias("risk"), c["keyword_matching"].alias("matched"), F.col("total_score").alias("total"), F.array_join("covered_points", ",").alias("covered"), F.array_join("missing_points", ",").alias("missing"))


@query("SELECT conv_id, turn, round(0.7 * s + 0.3 * k, 4) AS score, topic FROM (SELECT conv_id, turn, topic, s, k, row_number() OVER (PARTITION BY conv_id, turn ORDER BY 0.7 * s + 0.3 * k DESC, place) AS r FROM (SELECT conv_id, turn, 0 AS place, 'a' AS topic, (length(text) % 8) / 8 AS s, (contains(text, 'the')::INT + contains(text, 'ation')::INT) / 2 AS k FROM conversations UNION ALL SELECT conv_id, turn, 1, 'b', (length(text) % 4) / 4, contains(text, 'ing')::INT FROM conversations)) WHERE r = 1")
def semantic_topic(spark: SparkSession, d: str) -> DataFrame:
    """The best of two topics by a model's similarity and by words; a length stands for the model."""
    said = keywords.semantic_topics(F.col("text"), {"a": F.length("text") % 8 / 8, "b": F.length("text") % 4 / 4}, {"a": ["the", "ation"], "b": ["ing"]}, 1)
    return read(spark, d, "conversations").select("conv_id", "turn", F.round(said[0]["score"], 4).alias("score"), said[0]["topic"].alias("topic"))


@query("SELECT event_id, CASE WHEN p > 0.6 THEN 'positive' WHEN p < 0.4 THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT event_id, (event_id % 101) / 100 AS p FROM events)")
def model_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", sentiment.from_model_score(F.col("event_id") % 101 / 100)["sentiment"].alias("sentiment"))


@query("SELECT conv_id, max(turn)::INT + 1 AS duration FROM conversations GROUP BY conv_id")
def durations(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), (F.col("turn") + 1).cast("double").alias("end_time"))
    return timeline.meeting_duration(c, "conv_id")


@query("SELECT conv_id, coalesce(role, 'unknown') AS speaker, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS starts FROM conversations GROUP BY conv_id, coalesce(role, 'unknown')")
def participation_stretches(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1).cast("double").alias("end_time"))
    starts = F.array_join(F.transform("segments", lambda x: x["start"].cast("int").cast("string")), ",")
    return timeline.participation_segments(c, "conv_id").select("conv_id", "speaker", starts.alias("starts"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN CASE WHEN contains(left(text, 79), '。') AND 1 = 0 THEN '' ELSE left(text, 77) || '...' END WHEN length(text) < 80 AND length(text) > 5 AND NOT ends_with(text, '。') THEN text || '。' ELSE text END AS said FROM documents")
def fitted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts at the length of a summary; none of these has a Chinese stop, which would be where it is cut."""
    return read(spark, d, "documents").select("doc_id", summary.fitted(F.col("text"), 80).alias("said"))


_PREDICATES = [
    # text, worth a summary, makes a point, poor
    (1, "项目进度需要在本周五之前完成所有测试工作并提交报告", True, True, False),
    (2, "好的", False, False, True),
    (3, "这个方案到底为什么要这样做呢？", False, True, False),
    (4, "测试测试测试测试测试测试", False, False, True),
    (5, "比如说我们上个月的销售数据就很好", False, False, False),
    (6, "数据 12345 67890 98.76 54.32%", False, False, False),
]


@query(_values([(x[0], x[4]) for x in _PREDICATES], "id, poor"))
def poor_texts(spark: SparkSession, d: str) -> DataFrame:
    """Too short, or the same over and over."""
    rows = spark.createDataFrame([(x[0], x[1]) for x in _PREDICATES], "id int, t string")
    return rows.select("id", T.poor(F.col("t"), T.words(F.col("t"))).alias("poor"))


@query("SELECT doc_id, (length(text) >= 12 AND NOT ends_with(text, '?') AND (length(text) >= 20 OR contains(text, 'tion'))) AS worth, (length(text) >= 15 AND NOT (len(regexp_extract_all(text, '[0-9.%]')) > 0 AND len(regexp_extract_all(text, '[0-9.%]')) / length(text) > 0.15 AND length(text) < 40) AND (contains(text, 'tion') OR length(text) >= 25)) AS point FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS text FROM documents WHERE text IS NOT NULL)")
def worthwhile_lines(spark: SparkSession, d: str) -> DataFrame:
    """Which lines of the documents would go into a summary by length, figures, questions and keywords."""
    lines = read(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    keys = F.array(F.lit("tion"))
    return lines.select("doc_id", T.worth_a_summary(F.col("t"), keys).alias("worth"), T.makes_a_point(F.col("t"), keys).alias("point"))


@query(_values([(1, "会议讨论项目。大家同意，会后执行"), (2, "按计划推进")], "id, said"))
def finished_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "会议会议讨论项目。。大家同意，，会后执行"), (2, "按计划推进按计划推进")], "id int, t string")
    return rows.select("id", T.finished(F.col("t")).alias("said"))


@query("SELECT doc_id, i, s AS sentence FROM (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), '。'), '[。！？!?]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 5) AS x FROM documents) WHERE len(x) >= 5)")
def smart_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents that have five by line ends and strong signs, which is the first level of the cascade."""
    docs = read(spark, d, "documents").select("doc_id", sentences.leveled_sentences(F.col("text")).alias("s"))
    return docs.where("s.level = 0").select("doc_id", F.posexplode("s.sentences").alias("i", "sentence"))


@query(_values([(1, "甲" * 30 + "|" + L.CUE_WORDS[0] + "乙" * 30), (2, "丙" * 59 + "。|" + "丁" * 60 + "|" + "丁" * 60 + "|" + "丁" * 22), (3, "短文本")], "id, said"))
def cut_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Texts with too few signs: cut before a cue word, by length after a stop, or left whole."""
    rows = [(1, "甲" * 30 + L.CUE_WORDS[0] + "乙" * 30), (2, "丙" * 59 + "。" + "丁" * 142), (3, "短文本")]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.array_join(sentences.sentences(F.col("t")), "|").alias("said"))


@query(_values([(1, "0,1,2"), (2, "0,2,3")], "id, kept"))
def best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Few sentences stay as they are; of more, those that share words with others win, in their own order."""
    rows = [(1, ["aa bb", "cc dd", "ee ff"], []), (2, ["red green blue", "lone words here", "green blue red", "blue red green"], ["red"])]
    out = sentences.key_sentences(spark.createDataFrame(rows, "id int, sentences array<string>, keywords array<string>"), "id", 3, tokenize=str.split)
    given = spark.createDataFrame(rows, "id int, sentences array<string>, keywords array<string>").select("id", "sentences")
    place = F.transform("key_sentences", lambda s: (F.array_position("sentences", s) - 1).cast("string"))
    return out.join(given, "id").select("id", F.array_join(place, ",").alias("kept"))


@query("SELECT conv_id, list_distinct(list_transform(regexp_extract_all(t, '[a-z]+'), lambda w: w[1:3])).len()::INT AS n FROM (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def first_of_a_kind(spark: SparkSession, d: str) -> DataFrame:
    """Words of a conversation without those that begin like one before."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lower("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    words = F.regexp_extract_all("t", F.lit("[a-z]+"), F.lit(0))
    kept = sentences.suppress_repeats(words, lambda x, y: F.substring(x, 1, 3) == F.substring(y, 1, 3), 1 << 20)
    return c.select("conv_id", F.size(kept).alias("n"))


@query(_values([(1, False), (2, True)], "id, invented"))
def invented_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary in the text's own words, and one of other names."""
    rows = [(1, "budget plan review", "the budget plan review went on"), (2, "spaceship lottery elephants", "the budget plan review went on")]
    t = spark.createDataFrame(rows, "id int, s string, t string")
    return t.select("id", T.invented(F.col("s"), F.col("t"), T.words(F.col("s")), T.words(F.col("t"))).alias("invented"))


# ---- streams


_CHUNKS = "f AS (SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1e6 AS at, value / 500 AS level FROM events)"
MEETING_SQL = f"""WITH RECURSIVE {_CHUNKS},
s AS (SELECT DISTINCT key, 0::BIGINT AS n, false AS active, 0::DOUBLE AS speech, 0::DOUBLE AS silence, 0::DOUBLE AS started, NULL::VARCHAR AS event, NULL::DOUBLE AS "at", NULL::DOUBLE AS value FROM f
 UNION ALL SELECT x.key, x.n, CASE WHEN begins THEN true WHEN ends THEN false ELSE x.active END, x.speech, x.silence, CASE WHEN begins THEN x.at - x.speech ELSE x.started END,
  CASE WHEN begins THEN 'start' WHEN ends THEN 'end' END, CASE WHEN begins THEN x.at - x.speech WHEN ends THEN x.at - 20 END, CASE WHEN begins THEN least(1.0, x.speech / 10) WHEN ends THEN x.at - x.started END
 FROM (SELECT y.*, y.loud AND NOT y.active AND y.speech >= 3 AS begins, NOT y.loud AND y.active AND y.silence >= 60 AND y.at - y.started >= 60 AS ends
  FROM (SELECT f.key, f.n, f.at, f.level > 0.03 AS loud, s.active, s.started, CASE WHEN f.level > 0.03 THEN s.speech + 20 ELSE 0 END AS speech, CASE WHEN f.level > 0.03 THEN 0 ELSE s.silence + 20 END AS silence
   FROM s JOIN f ON f.key = s.key AND f.n = s.n + 1) y) x)
SELECT key, event, s."at", value FROM s WHERE event IS NOT NULL"""
PIECES_SQL = f"""WITH RECURSIVE {_CHUNKS}, z AS (SELECT key, max(n) AS last FROM f GROUP BY key),
s AS (SELECT DISTINCT key, 0::BIGINT AS n, 0::DOUBLE AS held, 0::DOUBLE AS silence, false AS speaking, 0::DOUBLE AS origin, 0 AS chunks, false AS gives, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS c FROM f
 UNION ALL SELECT key, n, CASE WHEN cut THEN 0 ELSE held END, CASE WHEN cut THEN 0 ELSE silence END, CASE WHEN cut THEN false ELSE speaking END, CASE WHEN cut THEN origin + held ELSE origin END, CASE WHEN cut THEN 0 ELSE chunks END, cut, origin, origin + held, chunks
 FROM (SELECT *, speaking AND silence >= 40 - 1e-9 OR held >= 200 - 1e-9 AS cut FROM (
  SELECT f.key, f.n, s.held + 20 AS held, CASE WHEN f.level > 0.015 THEN 0 ELSE s.silence + 20 END AS silence, s.speaking OR f.level > 0.015 AS speaking, s.origin, s.chunks + 1 AS chunks FROM s JOIN f ON f.key = s.key AND f.n = s.n + 1)))
SELECT key, a AS start, b AS "end", c AS n FROM s WHERE gives UNION ALL SELECT key, origin, origin + held, chunks FROM s JOIN z USING (key) WHERE n = last AND held >= 0.5"""


@query('SELECT user_id::VARCHAR AS key, min(n) * 20.0::DOUBLE AS start, min(n) * 20.0::DOUBLE + count(*) * 20.0::DOUBLE AS "end", count(*)::INT AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events) GROUP BY user_id, n // 5')
def fixed_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a hundred seconds, whatever is said, and what is left at the end."""
    e = read(spark, d, "events")
    chunks = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (micros("ts") / 1e6).alias("at"), F.lit(0.0).alias("level"), F.lit(20.0).alias("seconds"))
    return live.pieces_in(chunks, pause=0.0, longest=100.0).select("key", "start", "end", F.size("chunks").alias("n"))


@query(_values([("ends", 2), ("starts", 2)], "event, n"))
def idle_meetings(spark: SparkSession, d: str) -> DataFrame:
    """Two devices that speak, fall silent and speak again."""
    levels = [0.1] * 10 + [0.0] * 70 + [0.1] * 2
    rows = [(k, i, float(i), x, 1.0) for k in "ab" for i, x in enumerate(levels)]
    out = live.meetings_in(spark.createDataFrame(rows, "key string, seq long, at double, level double, seconds double"))
    return out.groupBy(F.concat("event", F.lit("s")).alias("event")).agg(F.count("*").cast("int").alias("n"))



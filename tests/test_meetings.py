import random
import time
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.tokens import tokens
from colloquy.operators import audio, compliance, diarize, timeline
from colloquy.plans import reports
from colloquy.sources import files, store
from colloquy.streaming import live
from colloquy.streaming.folds import Buffer, Detector, fixed_buffer


def test_speakers_by_interval(spark):
    segments = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 2.0, 3.0, 9.0, 130.0])], "m int, idx int, start_time double")
    spans = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 4.0, "B"), (1, 2, 100.0, 200.0, "C"), (2, 0, 0.0, 99.0, "D")], "m int, idx int, start double, end double, speaker string")
    out = timeline.assign_speakers(segments, spans, "m").orderBy("idx").collect()
    assert [r["speaker"] for r in out] == ["A", "A", "B", "SPEAKER_00", "C"]


def merged(rows, least):
    out = []
    for s, e, p in rows:
        if out and out[-1][2] == p:
            out[-1][1] = e
        elif e - s < least and len(out) > 1:
            if out[-2][2] == p:
                out[-2][1] = e
                out.pop()
            else:
                out[-1][1] = e
        else:
            out.append([s, e, p])
    return [tuple(x) for x in out]


def test_merge_short_against_a_loop(spark):
    dice, rows = random.Random(3), []
    for m in range(40):
        at = 0.0
        for i in range(dice.randint(1, 10)):
            end = at + dice.choice([0.1, 0.2, 1.0])
            rows.append((m, i, at, end, dice.choice("ABC")))
            at = end
    out = timeline.merged_short(spark.createDataFrame(rows, "m int, idx int, start double, end double, speaker string"), "m", 0.3).orderBy("m", "idx").collect()
    for m in range(40):
        assert [(r["start"], r["end"], r["speaker"]) for r in out if r["m"] == m] == merged([r[2:] for r in rows if r[0] == m], 0.3)


def test_participation_adds_up(spark):
    rows = spark.createDataFrame([(1, "A", 0.0, 3.0), (1, None, 3.0, 4.0), (2, "B", 0.0, 0.0)], "m int, speaker string, start_time double, end_time double")
    out = {(r["m"], r["speaker"]): r["percentage"] for r in timeline.participation(rows, "m").collect()}
    assert out == {(1, "A"): 75.0, (1, "unknown"): 25.0, (2, "B"): 0.0}


def test_median_against_a_loop(spark):
    dice = random.Random(4)
    for n in (1, 2, 3, 12):
        labels = [dice.randint(0, 2) for _ in range(n)]
        padded = [labels[min(max(k, 0), n - 1)] for k in range(n)] if n < 2 else None
        mirror = lambda k: -1 - k if k < 0 else 2 * n - 1 - k if k >= n else k
        want = [sorted(labels[min(max(mirror(k + j), 0), n - 1)] for j in (-2, -1, 0, 1, 2))[2] for k in range(n)]
        rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "m int, i int, label int")
        assert padded is None or want == padded
        assert [r["label"] for r in timeline.median_smoothed(rows, "m", "i", "label").orderBy("i").collect()] == want


def test_scores_and_empty_base(spark):
    rows = spark.createDataFrame([(1, "我们讨论反对意见", [("我们讨论反对意见", 0.0, 1.0)])], f"id int, text string, segments {compliance.SEGMENTS}")
    none = compliance.score(rows, []).first()
    assert none["total_score"] == 0 and none["suggestions"] == ["知识库为空，请先添加合规检查规则"]
    items = [compliance.Item(t, c, compliance.GROUPS[k], w, p) for t, c, k, w, p in store.SEED_ITEMS]
    out = compliance.report(compliance.score(rows, items, tokens=tokens)).first()
    assert out["risk_keywords"] == ["反对"] and 0 <= out["total_score"] <= 100
    assert {m["severity"] for m in out["risk_time_markers"]} == {"high"} and out["report"]["summary"]["risk_items_count"] == 1


def test_rule_matches_multiply(spark):
    text = "稳赚，一定赚"
    rows = spark.createDataFrame([(text, [(text, 0.0, 1.0), ("没有", 1.0, 2.0)])], f"text string, segments {compliance.SEGMENTS}")
    found = rows.select(compliance.risk_rows(F.col("text"), F.col("segments"), [("一定赚|稳赚", "c", "high")]).alias("r")).first()["r"]
    assert len(found) == 4 and {r["keyword"] for r in found} == {"稳赚", "一定赚"}


def test_live_alerts(spark):
    items = [compliance.Item("r", "", "risk", ["抵制", "保本"]), compliance.Item("p", "", "points", ["告知"], ["x", ""])]
    out = compliance.live_check(spark.createDataFrame([("大家抵制并告知",), ("禁止保本",), (None,)], "text string"), items).collect()
    assert [r["has_risk"] for r in out] == [True, False, False] and out[0]["alerts"] == ["检测到高风险内容：抵制"] and out[0]["covered"][0]["point"] == "x"


def test_added_rows_leave_old_files(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id bigint, title string")
    folders = lambda: sorted(p.name for p in (tmp_path / "db" / "meetings").iterdir())
    ids = lambda: sorted(r["id"] for r in s.table("meetings").collect())
    s.insert("meetings", rows(1, 2))
    s.insert("meetings", rows(3))
    assert folders() == ["v1.added", "v2.added"] and ids() == [1, 2, 3]
    (tmp_path / "db" / "meetings" / "v3").mkdir()  # a write that never ended
    assert ids() == [1, 2, 3]
    (tmp_path / "db" / "meetings" / "v3").rmdir()
    s.update("meetings", 1, title="new")
    s.insert("meetings", rows(4))
    s.insert("meetings", spark.createDataFrame([("t",)], "title string"))
    assert ids()[:4] == [1, 2, 3, 4] and len(ids()) == 5 and ids()[4] > 4 and s.get("meetings", 1)["title"] == "new"
    s.delete("meetings", 2)
    assert ids()[:3] == [1, 3, 4] and len(ids()) == 4 and folders() == ["v1.added", "v2.added", "v3", "v4.added", "v5.added", "v6"]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.seed()
    s.seed()
    assert s.table("knowledge_base").count() == 6 and s.weights()["point_coverage"] == 30.0
    s.set_weights({"point_coverage": 25, "extra": 1})
    assert s.weights() == {"semantic_similarity": 40.0, "point_coverage": 25.0, "risk_detection": 20.0, "keyword_matching": 10.0, "extra": 1.0}
    s.insert("meetings", spark.createDataFrame([("a", "finished", 0.0), ("b", "processing", 80.0)], "title string, status string, total_score double"))
    ids = {r["title"]: r["id"] for r in s.list_meetings().collect()}
    assert len(set(ids.values())) == 2 and s.list_meetings(status="finished").count() == 1
    assert [r["total_score"] for r in s.list_meetings(status="finished").collect()] == [None]
    s.update("meetings", ids["a"], title="c")
    s.insert("segments", spark.createDataFrame([(ids["a"], 0, "A", "t"), (ids["b"], 0, "B", "u")], "meeting_id long, idx int, speaker string, text string"))
    s.insert("compliance_reports", spark.createDataFrame([(ids["a"], 50.0)], "meeting_id long, total_score double"))
    detail = s.meeting_detail(ids["a"]).first()
    assert detail["title"] == "c" and detail["transcriptions"][0]["text"] == "t" and detail["compliance_report"]["total_score"] == 50.0
    s.delete_meeting(ids["a"])
    assert s.table("segments").count() == 1 and s.table("compliance_reports").count() == 0
    for call in (lambda: s.get("meetings", ids["a"]), lambda: s.report(ids["a"]), lambda: s.list_meetings(9)):
        with pytest.raises(store.NotFound):
            call()
    assert s.search_items("理财").count() == 2 and s.search_items("公_会议").count() == 1
    assert set(s.diagnose()) == set(store.TABLES)


def test_reports(spark):
    rows = spark.createDataFrame([("2024-01-01", 95.0, "优秀", 10, ["a"], []), ("2024-01-02", 80.0, "良好", 20, None, None), ("2024-01-03", None, None, None, [], ["x"])], "date string, score double, level string, duration int, risks array<string>, missing array<string>")
    out = reports.trend(rows).first().asDict()
    assert (out["total"], out["avg_score"], out["excellent"], out["good"], out["pass"], out["fail"], out["total_risks"], out["total_missing"]) == (3, 58.33, 1, 1, 0, 1, 1, 1)
    assert out["recommendations"] == ["整体合规评分偏低，建议加强合规培训"]
    assert "58.33" in reports.html("compliance_trend", out) and "&lt;b&gt;" in reports.html("meeting_summary", {"title": "<b>", "total_score": 95.0}) and "未知" in reports.html("x", {})


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一章 总则\n1、必须按时参加会议\n".encode("gbk"))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>标题</w:t></w:r></w:p><w:p><w:r><w:t>正文</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(b"broken")
    out = {r["name"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert out == {"a.txt": "第一章 总则\n1、必须按时参加会议\n", "b.docx": "标题\n正文", "c.docx": ""}
    p = files.policies(files.read_texts(spark, str(tmp_path))).where("name = 'a.txt'").first()
    assert p["title"] == "第一章总则" and p["required_points"] == ["必须按时参加会议"]
    (tmp_path / "d.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file"):
        files.read_texts(spark, str(tmp_path)).collect()


def tone(hz, seconds, level=0.5, rate=16000):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_signal_steps():
    x = tone(440, 2) + np.random.default_rng(0).normal(0, 0.05, 32000)
    assert np.allclose(audio.istft(audio.stft(x), len(x))[1024:-1024], x[1024:-1024], atol=1e-8)
    assert 20 * np.log10(np.sqrt(np.mean(audio.normalise(x) ** 2))) == pytest.approx(-20, abs=0.1)
    assert np.array_equal(audio.normalise(np.zeros(10)), np.zeros(10))
    low, kept = audio.band_pass(tone(20, 2)), audio.band_pass(tone(1000, 2))
    assert np.abs(low[8000:-8000]).max() < 0.05 and np.abs(kept[8000:-8000]).max() == pytest.approx(0.5, abs=0.01)
    assert len(audio.preprocess(x)) == len(x) and np.isfinite(audio.preprocess(x)).all()
    echo = x + 0.4 * np.r_[np.zeros(100), x[:-100]]
    assert len(audio.cancel_echo(echo[:4000])) == 4000
    f = audio.frame_features(x)
    assert f.shape[1] == 76 and np.isfinite(f).all()


def test_gate_keeps_tones_and_takes_noise():
    noise = np.random.default_rng(1).normal(0, 0.02, 48000)
    x = noise.copy()
    x[16000:32000] += tone(1000, 1)[:16000]
    out = audio.gate_noise(x)
    power = lambda y, a, b: float(np.mean(y[a:b] ** 2))
    assert len(out) == len(x) and power(out, 34000, 46000) < 0.1 * power(x, 34000, 46000)
    assert power(out, 18000, 30000) == pytest.approx(0.125, rel=0.05)
    other = audio.subtract_noise(x)
    assert np.abs(out - other)[18000:30000].max() > 0.003
    assert np.abs(audio.gate_noise(x, share=0.0) - x)[2048:-2048].max() < 1e-6
    given = audio.gate_noise(x[16000:], noise=noise[:16000])
    assert power(given, 18000, 30000) < 0.1 * power(x, 34000, 46000)
    for short in (np.zeros(0), np.zeros(1), np.ones(100), np.zeros(5000)):
        assert len(audio.gate_noise(short)) == len(short) and np.isfinite(audio.gate_noise(short)).all()
    assert np.isfinite(audio.preprocess(x, audio.gate_noise)).all()


def test_recordings_and_voices(spark, tmp_path):
    x = np.concatenate([tone(300, 2), np.zeros(16000), tone(900, 2)])
    (tmp_path / "a.wav").write_bytes(files.wav_bytes(x))
    rec = files.read_recordings(spark, str(tmp_path))
    assert len(rec.first()["samples"]) == len(x)
    frames = audio.frames_of(rec)
    voices = timeline.voice_runs(frames, "path", "i", F.col("rms") > 0.05, F.col("i") * 512 / 16000, F.col("i") * 512 / 16000).orderBy("start").collect()
    assert len(voices) == 2 and voices[1]["start"] == pytest.approx(3, abs=0.1)
    out = diarize.diarize(frames.withColumn("duration", F.lit(5.0)), "path", speakers=2).orderBy("idx").collect()
    assert out[0]["start"] == 0 and out[-1]["end"] == 5.0 and len({r["speaker"] for r in out}) == 2
    q = audio.quality_report(spark.createDataFrame([([0.5, -0.5], [0.25, -0.25])], "before array<double>, after array<double>")).first()["quality"]
    assert (q["snr_before"], q["noise_reduction_db"]) == (0.0, pytest.approx(6.02))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    db = store.Store(spark, f"file://{tmp_path}/db")
    db.insert("meetings", spark.createDataFrame([("first", 0)], "title string, duration int").coalesce(1))

    def write(k):
        own = store.Store(spark, db.folder)
        own.insert("meetings", spark.createDataFrame([(f"m{k}", k), (f"n{k}", k)], "title string, duration int"))
        own.update("meetings", 1, **({"summary": "s"} if k % 2 else {"status": "done"}))
        return k

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(write, range(4))) == [0, 1, 2, 3]
    rows = db.table("meetings").collect()
    assert len(rows) == len({r["id"] for r in rows}) == 9 and {r["title"] for r in rows} == {"first", *(f"{x}{k}" for x in "mn" for k in range(4))}
    assert (db.get("meetings", 1)["summary"], db.get("meetings", 1)["status"]) == ("s", "done")
    assert not [p.name for p in (tmp_path / "db" / "meetings").iterdir() if p.name.startswith("claim")]


def test_a_lost_writers_claim_is_removed(spark, tmp_path, monkeypatch):
    db = store.Store(spark, f"file://{tmp_path}/db")
    (tmp_path / "db" / "meetings" / "claimed-1").mkdir(parents=True)
    (tmp_path / "db" / "meetings" / "claimed-1" / "by-another").touch()
    monkeypatch.setattr(store, "STALE", 1)
    db.insert("meetings", spark.createDataFrame([("x",)], "title string").coalesce(1))
    assert db.get("meetings", 1)["title"] == "x"


def test_detector_and_buffers():
    d, events = Detector(), []
    for i in range(3):
        events.append(d.add(float(i), 0.05, 1.0))
    assert events == [None, None, ("start", -1.0, 0.3)]
    ends = [d.add(3.0 + i, 0.001, 1.0) for i in range(61)]
    assert [e for e in ends if e] == [("end", 61.0, 63.0)]
    b = Buffer()
    assert [b.add(i, 0.1 if i < 4 else 0.0, 0.2) for i in range(6)] == [None] * 5 + [(0.0, 1.2, [0, 1, 2, 3, 4, 5])]
    assert b.add(6, 0.0, 0.4) is None and b.end() is None and b.offset == pytest.approx(1.2)
    f = fixed_buffer()
    assert [f.add(i, 0.0, 2.0) for i in range(3)][-1] == (0.0, 6.0, [0, 1, 2])


def test_streams_equal_batches(spark, tmp_path):
    dice = random.Random(5)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = [(k, i, float(i), dice.choice([0.0, 0.1]) if i < 200 else 0.0, 1.0, i == 299) for k in "ab" for i in range(300)]
    schema = "key string, seq long, at double, level double, seconds double, last boolean"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 150 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    batch = spark.createDataFrame(rows, schema)
    for name, make, want in (("events", live.meetings_stream, live.meetings_in(batch)), ("pieces", lambda s: live.pieces_stream(s, pause=2.0), live.pieces_in(batch, pause=2.0))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        expected, until = sorted(map(repr, want.collect())), time.time() + 60
        # timeouts keep the query busy without new data, so that it is watched rather than waited for
        while spark.table(name).count() < len(expected) and time.time() < until:
            time.sleep(0.5)
        got = sorted(map(repr, spark.table(name).collect()))
        q.stop()
        assert got == expected, name
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_windows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=m), "a", 1.0, "u") for m in (0, 1, 20, 50)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double, user_id string")
    assert live.sessions(events, "user_id", "30 minutes").count() == 1 and live.tumbling(events, "10 minutes").count() == 3

"""A register of sessions: streams say what batches say, whatever comes late, twice or without a start."""

import random
import time

from colloquy.streaming import sessions

SCHEMA = "session string, seq long, kind string, level double, seconds double, extra string"


def messages(seed=1):
    """Sessions with starts, stops, restarts, chunks before a start and after a stop, and one that nothing ends."""
    dice, rows = random.Random(seed), []
    for name in ("a", "b", "c"):
        kinds = ["chunk", "start", *["chunk"] * 30, "start", *["chunk"] * 20, "stop", "chunk", "stop", "other", "start", *["chunk"] * 7]
        rows += [(name, i, kind, dice.choice([0.0, 0.1, None]), dice.choice([0.2, 0.5]), "x") for i, kind in enumerate(kinds)]
    return rows


def told(rows):
    return sorted((r["session"], r["seq"], r["event"], -1 if r["start"] is None else r["start"], -1 if r["end"] is None else r["end"], tuple(r["chunks"]), r["message"] or "") for r in rows)


def test_machine():
    s = sessions.Session({"pause": 0.0, "longest": 2.0})
    for m in [(0, "chunk", 0.1, 1.0), (2, "chunk", 0.1, 1.0), (2, "chunk", 0.9, 9.0), (1, "start", 0.0, 0.0), (1, "start", 0.0, 0.0), (3, "chunk", 0.1, 1.0), (5, "stop", 0.0, 0.0)]:
        s.take(*m)
    assert [x[:4] for x in s.said] == [(0, "error", None, None), (1, "started", 0.0, 0.0), (3, "piece", 0.0, 2.0)] and s.said[2][4] == [2, 3]
    assert s.said[0][5] == sessions.NO_SESSION and sorted(s.waiting) == [5]
    again = sessions.Session({"pause": 0.0, "longest": 2.0}).restore(*s.state())
    again.waiting = dict(s.waiting)
    again.end()
    assert [x[:4] for x in again.said] == [(5, "stopped", 0.0, 2.0)] and not again.active


def test_order_and_repeats_change_nothing(spark):
    rows = messages()
    want = told(sessions.sessions_in(spark.createDataFrame(rows, SCHEMA)).collect())
    shuffled = rows + random.Random(3).sample(rows, 60) + [(None, 0, "start", 0.1, 1.0, "x"), ("a", None, "stop", 0.1, 1.0, "x")]
    random.Random(4).shuffle(shuffled)
    assert told(sessions.sessions_in(spark.createDataFrame(shuffled, SCHEMA).repartition(3)).collect()) == want
    assert {x[2] for x in want} == {"error", "started", "piece", "stopped", "expired"}
    assert sessions.sessions_in(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_equals_batch_with_late_and_repeated_messages(spark, tmp_path):
    rows = messages(2)
    late = rows[:]
    random.Random(6).shuffle(late)
    late = [r for r in late if r[:2] != ("b", 4)]  # never comes
    parts = [late[i::4] + late[:5] for i in range(4)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    want = told(sessions.sessions_in(spark.createDataFrame(late, SCHEMA)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    q = sessions.sessions_stream(stream, idle_seconds=20.0).writeStream.foreachBatch(sessions.keep(out)).option("checkpointLocation", f"{tmp_path}/at").start()
    got, until = [], time.time() + 120
    while len(got) < len(want) and time.time() < until and q.isActive:
        time.sleep(2)
        try:
            got = told(sessions.kept(spark, out).collect())
        except Exception:  # noqa: BLE001  no batch has ended yet, or one is being written
            continue
    failed = q.exception()
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert failed is None and got == want


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    rows = sessions.sessions_in(spark.createDataFrame(messages(), SCHEMA))
    put = sessions.keep(str(tmp_path / "s"))
    put(rows.where("session = 'a'"), 0)
    put(rows.where("session != 'a'"), 1)
    put(rows.where("session != 'a'"), 1)
    put(rows.where("session = 'a'"), 2)  # the same events in another batch
    assert told(sessions.kept(spark, str(tmp_path / "s")).collect()) == told(rows.collect())

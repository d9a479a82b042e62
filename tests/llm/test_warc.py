import gzip
import hashlib
import os
import random

import pyarrow.fs as pafs
import pytest

from colloquy.llm import warc
from colloquy.llm.scratch import new_path


def trip(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind int").repartition(3)
    return warc.read_archives(warc.write_archives(warc.with_revisits(pages), new_path(spark, "warc")), span=700).collect()


def test_round_trip(spark):
    big = "".join(random.Random(1).choice("abc<>é ") for _ in range(30000))
    rows = [(1, "http://a.de/ü", "x" * 99, 0), (2, None, "x" * 99, 0), (3, "u", "y" * 100, 0), (4, "u", "y" * 100, 0), (2, "v", "y" * 100, 0), (6, "w", None, 0), (7, "w", "", 0), (8, "b", big, 0), (None, "n", big, 0), (9, "m", "\r\n\r\nWARC/1.1\r\n", 0)]
    found = trip(spark, rows)
    assert len(found) == len(rows)
    want = sorted((r[0] or -1, len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows)
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in found) == want
    kinds = {(r["page_id"], r["payload_bytes"]): (r["type"], r["refers_to"]) for r in found}
    assert kinds[3, 100] == kinds[4, 100] == ("revisit", 2) and kinds[2, 100] == ("response", None)
    assert kinds[1, 99] == kinds[2, 99] == ("response", None)
    assert kinds[None, len(big.encode())] == ("revisit", 8)
    assert {r["url"] for r in found} == {r[1] for r in rows}
    assert all(bytes(r["payload"]) == b"" for r in found if r["type"] == "revisit")


def test_empty_table(spark):
    assert trip(spark, []) == []


@pytest.mark.parametrize("span", [1, 7, 64, 1000, 10**9])
def test_ranges_own_each_record_once(tmp_path, span):
    dice = random.Random(span)
    payloads = [dice.randbytes(dice.randint(0, 3000)) + warc.MAGIC * dice.randint(0, 3) for _ in range(12)]
    stored = [warc.record("response", i, "u", "d", p, None, "a", i) for i, p in enumerate(payloads)]
    inner = warc.MAGIC + b"no member" + gzip.compress(b"other content")
    raw = b"".join(warc.member(r, dice.choice([0, 4])) + dice.choice([b"", inner]) for r in stored)
    at = tmp_path / "a.warc.gz"
    at.write_bytes(raw)
    found = []
    with pafs.LocalFileSystem().open_input_file(str(at)) as f:
        for start in range(0, len(raw), span) if span > 1 else range(0, len(raw)):
            found += list(warc.members(f, len(raw), start, min(len(raw), start + span), "a"))
    assert [r for _, r in sorted(found)] == stored


def test_unfinished_files_are_not_read(spark):
    folder = new_path(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    files = warc.write_archives(warc.with_revisits(pages), folder)
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    with open(folder.removeprefix("file://") + "/stray.warc.gz.part", "wb") as f:
        f.write(warc.member(warc.record("response", 5, "u", "d", b"x", None, "stray", 0)))
    assert [r["page_id"] for r in warc.read_archives(files).collect()] == [1]


def test_a_stored_archive_inside_a_payload_owns_nothing(tmp_path):
    inside = warc.member(warc.record("response", 77, "u", "d", b"inner" * 50, None, "b", 0), 0)
    outer = warc.record("response", 1, "u", "d", inside, None, "a", 0)
    raw = warc.member(outer, 0) + warc.member(warc.record("response", 2, "u", "e", b"x", None, "a", 1))
    at = tmp_path / "a.warc.gz"
    at.write_bytes(raw)
    with pafs.LocalFileSystem().open_input_file(str(at)) as f:
        found = [r for start in range(0, len(raw), 64) for r in warc.members(f, len(raw), start, min(len(raw), start + 64), "a")]
    assert len(found) == 2 and found[0][1] == outer


def test_revisits_name_the_record_that_they_refer_to():
    said = [warc.parse_header(warc.record(k, p, "u", "d", b"x" * 200, r, "a", p))[0] for k, p, r in (("response", 3, None), ("revisit", 9, 3), ("response", 4, None))]
    assert said[1]["warc-refers-to"] == said[0]["warc-record-id"]
    assert len({x["warc-record-id"] for x in said}) == 3


def test_ranges_are_as_many_tasks(spark):
    dice = random.Random(3)
    text = "".join(chr(dice.randrange(97, 123)) for _ in range(400_000))
    pages = spark.createDataFrame([(i, "u", text[i * 7 :]) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(warc.with_revisits(pages), new_path(spark, "warc"))
    size = files.first()["size"]
    found = warc.read_archives(files, span=100_000)
    assert found.rdd.getNumPartitions() == -(-size // 100_000) > 4
    assert sorted(r["page_id"] for r in found.collect()) == [0, 1, 2, 3]

"""WARC archives: written as one gzip member per record, read back by byte ranges.

The writer puts every partition's records in a file of its own in the shared folder. The reader splits files into
ranges; a task scans its range for the gzip magic, takes a place for a record's start if what follows inflates to
a valid WARC header, owns the records that start in its range, and reads the last one past the range's end.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import look_up, new_path, table

MAGIC = b"\x1f\x8b\x08"
LEAST = 100
#: Bytes of a member that are inflated at first to look for a header.
PROBE = 4096


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, archive: str, nth: int) -> bytes:
    """One WARC/1.1 record: an HTTP response, or what revisits one and has its payload's length and digest in the header.

    A response's id comes from its page_id and digest, so that revisits can name it; other records' ids, and those of
    pages without an id, come from the archive's name and the record's number there.
    """
    revisit = kind == "revisit"
    own = record_id(page_id, digest) if not revisit and page_id is not None else record_id(archive, nth)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + own.encode(),
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"X-Archive: " + archive.encode(),
        b"X-Payload-Length: " + str(len(payload)).encode(),
    ]
    if page_id is not None:
        head.append(b"X-Page-Id: " + str(page_id).encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=~-._").encode())
    if revisit:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: " + record_id(refers_to, digest).encode())
        head.append(b"X-Refers-To-Page: " + str(refers_to).encode())
    head.append(b"Content-Length: " + str(len(block)).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The header's fields by lower-cased name, and where the block begins; None unless it is a whole valid header."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields and "warc-record-id" in fields else None


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, html, kind, refers_to) as archives below folder; returns (path, size), written by then.

    A task writes under a name of its own and renames the file when it is whole, so what a lost or repeated task
    leaves is never read: the returned table names the files that count. Digests and lengths are of the payload
    that is written or, for a revisit, of the one that it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        path = f"{base}/{name}.warc.gz"
        size, nth, out = 0, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path + ".part", compression=None)
                payload = (r["html"] or "").encode("utf-8", "replace")
                digest = hashlib.sha256(payload).hexdigest()
                raw = member(record(r["kind"], r["page_id"], r["url"], digest, payload, r["refers_to"], name, nth))
                out.write(raw)
                size, nth = size + len(raw), nth + 1
        if out is not None:
            out.close()
            fs.move(path + ".part", path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "size": pa.array([size], pa.int64())})

    manifest = f"{folder}/manifest"
    rows.select("page_id", "url", "html", "kind", "refers_to").mapInArrow(run, "path string, size long").write.parquet(manifest)
    return rows.sparkSession.read.schema("path string, size long").parquet(manifest)


class _Window:
    """A file's bytes from a position on, read piece by piece and forgotten behind it."""

    def __init__(self, f, start: int, size: int, piece: int = 1 << 20):
        self._f, self._size, self._piece = f, size, piece
        self.start, self.data = start, b""

    def upto(self, end: int) -> bool:
        """Whether the bytes up to position end are held, after reading more if needed."""
        while self.start + len(self.data) < min(end, self._size):
            self.data += self._f.read_at(min(self._piece, self._size - self.start - len(self.data)), self.start + len(self.data))
        return self.start + len(self.data) >= end

    def forget(self, position: int) -> None:
        self.data = self.data[position - self.start :]
        self.start = position


def _inflated(w: _Window, at: int, archive: str) -> tuple[bytes, int] | None:
    """(record, position after its member) if a member that holds a valid record of this archive starts at `at`.

    A payload may itself be an archive and stand in a stored member as it is; its records name another archive.
    """
    z, parts, said, position, step = zlib.decompressobj(31), [], None, at, PROBE
    try:
        while not z.eof:
            w.upto(position + step)
            piece = w.data[position - w.start : position - w.start + step]
            if not piece:
                return None
            parts.append(z.decompress(piece))
            position += len(piece)
            if said is None:
                parts = [b"".join(parts)]
                said = parse_header(parts[0])
                if said is None and (not parts[0].startswith(b"WARC/1.") and len(parts[0]) > 6 or len(parts[0]) > 1 << 20):
                    return None
                step = 1 << 18
    except zlib.error:
        return None
    raw = b"".join(parts)
    if said is None or len(raw) != said[1] + int(said[0]["content-length"]) + 4 or said[0].get("x-archive", archive) != archive:
        return None
    return raw, position - len(z.unused_data)


def members(f, size: int, start: int, end: int, archive: str = "") -> Iterator[tuple[int, bytes]]:
    """(position, inflated record) of the records of file f, an archive of this name, that start at start or later and before end."""
    w, at = _Window(f, start, size), start
    while at < end:
        w.upto(min(end + len(MAGIC) - 1, at + (1 << 20)))
        hit = w.data.find(MAGIC, at - w.start)
        if hit < 0:
            at = max(at + 1, w.start + len(w.data) - len(MAGIC) + 1)  # a magic may begin in what is held
            if w.start + len(w.data) >= min(size, end + len(MAGIC) - 1):
                return
            w.forget(at)
            continue
        at = w.start + hit
        if at >= end:
            return
        found = _inflated(w, at, archive)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]
        w.forget(at)


RECORD = "path string, position long, type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


#: Tasks that read archives at most; each takes several ranges beyond.
MOST_TASKS = 100_000


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What a response's block holds after its HTTP header, if it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        head, empty, rest = block.partition(b"\r\n\r\n")
        return rest if empty else b""
    return block


def read_archives(files: DataFrame, span: int = 4 << 20) -> DataFrame:
    """One row for each record of files (path, size), read by ranges of `span` bytes, in any file system of pyarrow.fs.

    There are as many tasks as ranges, up to MOST_TASKS. The digest and length of a payload that is there are computed
    from it; a revisit's come from its header. Bytes between records that are no valid member are passed over. Files
    that hold no record give no row. Where an archive of another writer holds records of an archive in a stored
    member, a range that begins within that member takes them for its own; records of this writer name their archive.
    """
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("size") / span))).first()[0]
    ranges = ranges.repartition(max(1, min(n or 1, MOST_TASKS)))  # a given number is not made less at run time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(r["path"])
                archive = path.rpartition("/")[2].removesuffix(".warc.gz")
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for position, raw in members(f, r["size"], r["start"], min(r["size"], r["start"] + span), archive):
                        said, begin = parse_header(raw)
                        payload = payload_of(said, raw[begin:-4])
                        revisit = said["warc-type"] == "revisit"
                        digest = said.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        n = int(said.get("x-payload-length", 0)) if revisit else len(payload)
                        to, page, url = said.get("x-refers-to-page"), said.get("x-page-id"), said.get("warc-target-uri")
                        rows.append((r["path"], position, said["warc-type"], int(page) if page else None, unquote(url) if url is not None else None, digest, n, int(to) if to else None, payload))
                        held += len(payload)
                        if held > (8 << 20):
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, RECORD)


_KINDS = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=names)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) plus kind and refers_to.

    Among pages whose payloads are equal and at least `least` bytes, those with the smallest page_id are responses
    and the others revisit it; rows that repeat the smallest page_id are responses too, and a null page_id comes
    last. A null html is an empty payload. Payloads are compared by SHA-256; a digest's copies are counted where
    they are read. Repeated digests are looked up by `look_up`: html is shuffled only where they are many, and a hot
    digest's rows and those of short pages never gather in one task.
    """
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length("html") >= least, F.sha2("html", 256)).alias("digest"))
    firsts = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    found = look_up(rows, table(firsts, "firsts"), "digest", "n")
    return found.select("page_id", "url", "html", F.when(later, "revisit").otherwise("response").alias("kind"), F.when(later, F.col("first")).alias("refers_to"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archives(with_revisits(pages), new_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

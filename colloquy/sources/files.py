"""Files as sources: texts of policies, and recordings."""

from __future__ import annotations

import io
import wave
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions.tokens import tokens

TEXT_FILES = ("txt", "pdf", "docx", "doc")
AUDIO_FILES = ("wav", "mp3", "m4a", "flac", "ogg", "webm", "aac")
LEAST_UPLOAD = 1024
POLICY_CHARS = 5000
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def checked(files: DataFrame, allowed: tuple[str, ...], least: int = 0) -> DataFrame:
    """files, of which one with another extension or fewer bytes fails the query when it is read."""
    bad = ~extension(F.col("path")).isin(*allowed)
    small = F.col("length") < least
    path = F.when(bad, F.raise_error(F.concat(F.lit("unsupported file: "), "path"))).when(small, F.raise_error(F.concat(F.lit("file too small: "), "path"))).otherwise(F.col("path"))
    return files.withColumn("path", path)


def usable(files: DataFrame, allowed: tuple[str, ...] = AUDIO_FILES, least: int = LEAST_UPLOAD) -> DataFrame:
    """files that may be uploaded."""
    return files.where(extension(F.col("path")).isin(*allowed) & (F.col("length") >= least))


def decode_text(raw: bytes) -> str:
    """UTF-8 (with or without a mark), UTF-16 with a mark, else GBK; what does not decode is replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gbk", "replace")


def docx_text(raw: bytes) -> str:
    """Paragraphs of the document's body, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_WORD}body")
    parts = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda e: "\t", f"{_WORD}br": lambda e: "\n"}
    return "\n".join("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts) for p in (body if body is not None else []) if p.tag == f"{_WORD}p")


def read_texts(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, name, text) of text files below path. readers adds ones by extension, such as for pdf; without one, or where it fails, a text is empty."""
    known = {"txt": decode_text, "docx": docx_text} | (readers or {})

    @F.pandas_udf("string")
    def decode(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        def one(kind: str, raw: bytes) -> str:
            try:
                return known[kind](raw) if kind in known else ""
            except Exception:  # noqa: BLE001  a broken file is an empty one
                return ""

        return pd.Series([one(k, c) for k, c in zip(kinds, contents)])

    files = checked(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), TEXT_FILES)
    return files.select("path", file_name(F.col("path")).alias("name"), decode(extension(F.col("path")), "content").alias("text"))


def policies(texts: DataFrame, lexicon=None) -> DataFrame:
    """(name, title, content, keywords, required_points) of policy files; contents are cut at POLICY_CHARS characters."""
    content = F.substring(F.coalesce("text", F.lit("")), 1, POLICY_CHARS)
    at = texts.select("name", content.alias("content"))
    at = at.withColumn("words", tokens(F.regexp_replace("content", f"[^{T.CJK}a-zA-Z0-9]", " "), lexicon))
    kept = F.filter("words", lambda w: (F.length(w) >= 2) & (F.trim(w) != "") & ~w.isin(L.PARSER_STOP_WORDS_ZH))
    return at.withColumn("kept", kept).select("name", T.title_of(F.col("content"), F.col("name")).alias("title"), "content", most_frequent(F.col("kept"), 5).alias("keywords"), T.required_points(F.col("content")).alias("required_points"))


def most_frequent(words: Column, n: int) -> Column:
    """The n most frequent of an array, ties by first place."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda every: [w for w, _ in Counter(every if every is not None else ()).most_common(n)])

    return run(words)


def pcm_floats(raw: bytes | memoryview) -> np.ndarray:
    """Little-endian 16-bit samples as numbers below 1."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768


def wav_floats(raw: bytes, rate: int = 16000) -> np.ndarray:
    """A WAV file's samples, channels averaged, at the given rate by linear interpolation."""
    with wave.open(io.BytesIO(raw), "rb") as w:
        own, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        data = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = pcm_floats(data)
    elif width == 3:  # the three bytes become the upper ones of four
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel().astype(np.float32) / 2**31
    elif width == 4:
        x = np.frombuffer(data, "<i4").astype(np.float32) / 2**31
    else:
        raise ValueError(f"samples of {width} bytes")
    x = x.reshape(-1, channels).mean(1) if channels > 1 else x
    if own == rate or not len(x):
        return x
    n = int(round(len(x) * rate / own))
    return np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32)


def wav_bytes(samples: np.ndarray, rate: int = 16000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_recordings(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, rate, samples) of WAV files below path."""
    files = usable(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), ("wav",))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame({"path": t["path"], "rate": rate, "samples": [wav_floats(c, rate) for c in t["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")


def _joined(chunks: pa.BinaryArray) -> memoryview:
    """The bytes of all chunks, as they lie one after the other in the array: no chunk is an object of its own."""
    if chunks.null_count:
        raise ValueError("a chunk without samples")
    _, places, raw = chunks.buffers()
    at = np.frombuffer(places, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    return memoryview(raw or b"")[at[0] : at[-1]]


def recordings_of(chunks: DataFrame, key: str = "session_id", rate: int = 16000) -> DataFrame:
    """(key, wav): each session's PCM chunks (seq, pcm) in order as one WAV file; a session's audio is one row."""
    joined = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "pcm"))).alias("c"))

    @F.arrow_udf("binary")
    def wav(lists: pa.Array) -> pa.Array:
        return pa.array((wav_bytes(pcm_floats(_joined(x.values.field("pcm"))), rate) for x in lists), pa.binary())

    return joined.select(key, wav("c").alias("wav"))


def from_base64(c: Column) -> Column:
    return F.unbase64(F.regexp_replace(c, "^data:[^,]*,", ""))

"""Audio features of payloads stored as 8-bit samples.

A payload becomes a WAV file of unsigned 8-bit mono samples, which loses nothing. Features come from the samples
as read back: polyphase resampling to half the rate, overlapped log-mel filterbanks cut into tensors of one fixed
shape, each with its time span, and segments where the energy stays above a threshold, with hysteresis.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import plus

RATE, UP, DOWN = 16000, 1, 2
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
#: Frames in one tensor. The last one is filled up with the floor value.
ROWS = 32
FLOOR = -10.0
#: A segment opens and closes at these distances from the median level (log10 of a frame's mean square).
OPEN_AT, CLOSE_AT = 0.03, -0.01
UNIT = 64


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(8)
def lowpass(up: int, down: int, half: int = 16) -> np.ndarray:
    """A Hamming-windowed sinc of 2 * half * max(up, down) + 1 taps that cuts at the lower of both rates."""
    top = max(up, down)
    n = np.arange(-half * top, half * top + 1)
    return (up / top * np.sinc(n / top) * np.hamming(len(n))).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate: each output sample takes only the filter phase that meets real input samples."""
    taps = lowpass(up, down)
    centre = len(taps) // 2
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for phase in range(min(up, n)):  # outputs phase, phase + up, ... share one phase of the filter
        at = phase * down + centre
        first, part = at // up, taps[at % up :: up]
        behind = len(part) - 1 - first
        padded = np.concatenate([np.zeros(max(0, behind), np.float32), x, np.zeros(len(part) + down, np.float32)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, len(part))[max(0, -behind) :: down]
        k = len(out[phase::up])
        out[phase::up] = rows[:k] @ part[::-1]
    return out


@lru_cache(1)
def mel_bank() -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the bins of the half spectrum."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    up = (bins[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    down = (points[2:] - bins[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def frames(payload: bytes, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-mel rows, log mean squares) of overlapping frames, in blocks; the last frame is filled up with silence."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    x -= 128
    x /= 128
    y = resample(x, UP, DOWN)
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    window = np.hanning(FRAME).astype(np.float32)
    for i in range(0, n, block):
        part = cut[i : i + block]
        spectrum = np.fft.rfft(part * window, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        yield np.maximum(FLOOR, np.log10(power @ mel_bank() + 1e-10)), np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-10)


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of stretches that open above OPEN_AT and close below CLOSE_AT.

    Levels are taken from the median, but at least from -6, so that silence has no segment. Both are rounded to
    thousandths, so that the last bits of a sum decide nothing.
    """
    level = np.round(level.astype(np.float64), 3)
    level = np.round(level - max(-6.0, float(np.median(level))), 3)
    state = np.zeros(len(level), np.int8)
    state[level > OPEN_AT] = 1
    state[level < CLOSE_AT] = -1
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.zeros(len(level), np.int64)
    last[known] = known
    last = np.maximum.accumulate(last)
    on = np.concatenate([[False], state[last] == 1, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


#: What a row's tensors hold, in the form of pa.ipc.read_record_batch.
TENSORS = pa.schema([("mel", pa.fixed_shape_tensor(pa.float32(), (ROWS, MELS))), ("start", pa.float64()), ("end", pa.float64())])
SECOND, LENGTH = HOP * DOWN / (RATE * UP), FRAME * DOWN / (RATE * UP)


def tensors(rows: np.ndarray) -> bytes:
    """All rows as tensors of shape (ROWS, MELS) with their time spans in seconds, as one serialised Arrow batch."""
    n = -(-len(rows) // ROWS)
    full = np.full((n * ROWS, MELS), FLOOR, np.float32)
    full[: len(rows)] = rows
    first = np.arange(n) * ROWS
    last = np.minimum(first + ROWS, len(rows)) - 1
    mel = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, ROWS, MELS))
    return pa.RecordBatch.from_arrays([mel, pa.array(first * SECOND), pa.array(last * SECOND + LENGTH)], schema=TENSORS).serialize().to_pybytes()


def read_tensors(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(stored), TENSORS)


def features(payload: bytes) -> tuple[bytes, int, list[tuple[float, float]]]:
    """(serialised tensors, how many they are, segments in seconds)."""
    parts = list(frames(payload))
    mel, level = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts))
    spans = [(a * SECOND, (b - 1) * SECOND + LENGTH) for a, b in segments(level)]
    return tensors(np.round(mel * 1000) / 1000), -(-len(mel) // ROWS), spans


def store_media(docs: DataFrame) -> DataFrame:
    """docs (with a column text) plus n_bytes and media: the text's UTF-8 bytes, filled up to a positive multiple of
    64, as a WAV file. A null text counts as empty; columns of these names are replaced, others pass through.
    """
    keep = docs.drop("n_bytes", "media")
    schema = plus(keep, "n_bytes long, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                raw = [(t or "").encode("utf-8", "replace") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                media = pa.array([to_wav(pad(r)) for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(r) for r in raw], pa.int64()), media], names=schema.names)

    return keep.mapInArrow(run, schema)


FEATURE_COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe_media(stored: DataFrame, want_tensors: bool = True) -> DataFrame:
    """stored (with a column media of WAV bytes, which goes) plus digests of what is read back, and its features.

    `feature` sums up the features: frames, tensors, segments and a digest of all of them. With want_tensors come
    `tensors` (fixed-shape tensors with time spans, for `read_tensors`) and `segments`. A null media is read as one
    without samples. Equal media give equal values.
    """
    keep = stored.drop("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "segments")
    rest = keep.drop("media")
    schema = plus(rest, FEATURE_COLUMNS + ", tensors binary, segments array<struct<start: double, end: double>>" * want_tensors)
    fields = [f for f in pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tensors", pa.binary()), ("segments", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])))])]
    fields = fields if want_tensors else fields[:6]

    def row(media: bytes | None) -> tuple:
        payload = from_wav(media) if media else b""
        stored, n, found = features(payload)
        digest = hashlib.sha256(stored + repr(found).encode()).hexdigest()[:32]
        text = f"mel={n}x{ROWS}x{MELS};segments={len(found)};sha256={digest}"
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), text, stored, [{"start": s, "end": e} for s, e in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                at = batch.schema.get_field_index("media")
                rows = [row(m) for m in batch.column(at).to_pylist()]
                own = [c for k, c in enumerate(batch.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields))], names=schema.names)

    # keep's media column is read by position, so that a column of the caller's never shadows it
    return keep.mapInArrow(run, schema)


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store_media(docs).select("doc_id", "n_bytes", "media")
    return describe_media(stored)

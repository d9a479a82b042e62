import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from colloquy.llm import audio


@pytest.mark.parametrize("up,down", [(1, 2), (2, 1), (3, 2), (2, 3), (1, 1)])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000])
def test_polyphase_is_filtering_of_the_stuffed_signal(up, down, n):
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    h = audio.lowpass(up, down)
    stuffed = np.zeros(n * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, h)[len(h) // 2 :][: len(stuffed)][::down]
    assert np.allclose(audio.resample(x, up, down), full, atol=1e-5)


def test_segments_have_hysteresis():
    level = np.array([0, 0, 0, 0.05, 0.0, 0.0, 0.05, -0.02, 0.0, 0.0, 0.04, 0, 0])
    assert audio.segments(level) == [(3, 7), (10, 13)]
    assert audio.segments(np.full(5, -10.0)) == []


def test_tensors_keep_rows_and_spans():
    rows = np.arange(70 * audio.MELS, dtype=np.float32).reshape(70, audio.MELS)
    t = audio.read_tensors(audio.tensors(rows))
    mel = t.column(0).to_numpy_ndarray()
    assert mel.shape == (3, audio.ROWS, audio.MELS)
    assert np.array_equal(mel.reshape(-1, audio.MELS)[:70], rows) and (mel.reshape(-1, audio.MELS)[70:] == audio.FLOOR).all()
    assert t.column(1).to_pylist()[1] == pytest.approx(0.32) and t.column(2).to_pylist()[-1] == pytest.approx(69 * 0.01 + 0.025)


def test_payloads_come_back(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "word " * 4000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "media_id")
    rows = audio.describe_media(audio.store_media(docs)).collect()
    for r, text in zip(rows, texts):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, audio.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(out.getvalue()) and r["media_sha256"] == hashlib.sha256(out.getvalue()).hexdigest()
        assert audio.read_tensors(r["tensors"]).num_rows >= 1
    assert rows[2]["feature"] == rows[7]["feature"] and rows[0]["feature"] == rows[1]["feature"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert audio.describe_media(audio.store_media(empty)).count() == 0


def brute_features(payload):
    """The feature string by plain loops over samples, frames and bins, in double precision."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    half = 16 * 2
    n = np.arange(-half, half + 1)
    taps = 0.5 * np.sinc(n / 2) * np.hamming(len(n))
    y = np.array([sum(taps[k + half] * x[i - k] for k in range(-half, half + 1) if 0 <= i - k < len(x)) for i in range(0, len(x), 2)])
    count = max(1, -(-(len(y) - 200) // 80) + 1)
    y = np.concatenate([y, np.zeros(max(0, (count - 1) * 80 + 200 - len(y)))])
    mel, level = [], []
    for f in range(count):
        frame = y[f * 80 : f * 80 + 200]
        power = np.abs(np.fft.fft(frame * np.hanning(200), 256)[:129]) ** 2
        mel.append(np.maximum(-10, np.log10(power @ audio.mel_bank().astype(float) + 1e-10)))
        level.append(np.log10((frame**2).mean() + 1e-10))
    level = np.round(level, 3)
    level = np.round(level - max(-6, np.median(level)), 3)
    spans, start = [], None
    for k, v in enumerate([*level, -1.0]):
        if start is None and v > 0.03:
            start = k
        elif start is not None and v < -0.01:
            spans.append((start, k))
            start = None
    if start is not None:
        spans.append((start, len(level)))
    return np.array(mel), [(a * 0.01, (b - 1) * 0.01 + 0.025) for a, b in spans]


@pytest.mark.parametrize("text", ["", "short", "The quick brown fox jumps over the lazy dog. " * 40, "Aa zz " * 300 + "\x00\x01" * 900 + "ÿé日本 " * 200])
def test_features_against_brute_force(text):
    payload = audio.pad(text.encode())
    stored, n, spans = audio.features(payload)
    mel, want = brute_features(payload)
    t = audio.read_tensors(stored)
    got = t.column(0).to_numpy_ndarray().reshape(-1, audio.MELS)
    assert n == t.num_rows == -(-len(mel) // audio.ROWS)
    assert np.allclose(got[: len(mel)], mel, atol=2e-2) and (got[len(mel) :] == audio.FLOOR).all()
    assert len(spans) == len(want) and np.allclose(spans, want) if want else not spans


def test_the_query_stores_tensors(spark):
    out = audio.op3_audio_features(spark, "/root/testdata/sf0.001").limit(3).collect()
    for r in out:
        t = audio.read_tensors(r["tensors"])
        assert t.column(0).type.shape == [audio.ROWS, audio.MELS] and r["feature"].startswith(f"mel={t.num_rows}x")
        assert all(s["start"] < s["end"] for s in r["segments"])


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "many words " * 400_000)], "doc_id long, text string")
    r = audio.describe_media(audio.store_media(docs)).first()
    assert r["payload_bytes"] == 4_400_000 and audio.read_tensors(r["tensors"]).num_rows == -(-(-(-(2_200_000 - 200) // 80) + 1) // 32)

"""Signal processing of recordings, in numpy within Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, FFT, HOP = 16000, 2048, 512


def stft(x: np.ndarray, size: int = FFT, hop: int = HOP) -> np.ndarray:
    """Spectra of Hann frames centred at multiples of hop, one row each."""
    padded = np.pad(x, size // 2, mode="constant")
    n = 1 + max(0, len(padded) - size) // hop
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(padded, (0, max(0, size - len(padded)))), size)[::hop][:n]
    return np.fft.rfft(frames * _window(size), axis=1)


def _window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def istft(spectra: np.ndarray, length: int, size: int = FFT, hop: int = HOP) -> np.ndarray:
    """The signal of so many samples whose frames these are, by weighted overlap-add."""
    w = _window(size)
    frames = np.fft.irfft(spectra, size, axis=1) * w
    out = np.zeros((len(frames) - 1) * hop + size)
    norm = np.zeros_like(out)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + size] += f
        norm[i * hop : i * hop + size] += w * w
    out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-10)[size // 2 :][:length]
    return np.pad(out, (0, length - len(out)))


def subtract_noise(x: np.ndarray) -> np.ndarray:
    """Takes twice the mean magnitude of the first frames (at most 20, a quarter of all) off every spectrum, down to 0.01."""
    s = stft(x)
    magnitude, phase = np.abs(s), np.exp(1j * np.angle(s))
    noise = magnitude[: max(1, min(20, len(s) // 4))].mean(0)
    return istft(np.maximum(magnitude - 2 * noise, 0.01) * phase, len(x))


def _smoothed(mask: np.ndarray, frames: int, bands: int) -> np.ndarray:
    """The mask averaged over so many neighbours on each side, nearer ones counting more, in time and then in frequency."""
    for axis, n in ((0, frames), (1, bands)):
        near = 1 - np.abs(np.arange(-n, n + 1)) / (n + 1)
        size = mask.shape[axis] + 2 * n
        whole = np.fft.irfft(np.fft.rfft(mask, size, axis=axis) * np.expand_dims(np.fft.rfft(near / near.sum(), size), 1 - axis), size, axis=axis)
        mask = np.take(whole, np.arange(n, n + mask.shape[axis]), axis=axis)
    return np.clip(mask, 0, 1)


def gate_noise(x: np.ndarray, noise: np.ndarray | None = None, deviations: float = 1.5, share: float = 1.0, sure: float = 12, hertz: float = 500, seconds: float = 0.05, rate: int = RATE) -> np.ndarray:
    """A spectral gate: what is no louder in its band than the noise's mean level and so many deviations is taken off by share.

    The noise is given or the first half second (a tenth of a shorter signal). Whether a place of the spectrum passes is
    smoothed over hertz and seconds around it, so that single bins neither ring nor leave holes; what is louder by `sure` decibels
    passes whatever is around it.
    """
    if noise is None:
        noise = x[: int(rate * 0.5)] if len(x) > rate * 0.5 else x[: max(1, len(x) // 10)]
    if not len(x) or not len(noise):
        return x
    level = lambda s: 20 * np.log10(np.abs(s) + 1e-10)
    s, profile = stft(x), level(stft(noise))
    over = level(s) - profile.mean(0) - deviations * profile.std(0)
    around = _smoothed((over > 0).astype(float), max(1, round(seconds * rate / HOP)), max(1, round(hertz * FFT / rate)))
    kept = np.maximum(around, np.clip(over / sure, 0, 1))
    return istft(s * (1 - share * (1 - kept)), len(x))


def band_pass(x: np.ndarray, low: float = 80, high: float = 7000, order: int = 4, rate: int = RATE) -> np.ndarray:
    """Zero-phase Butterworth band-pass: the squared magnitude response of the filter, applied to the spectrum at once."""
    if len(x) < 2:
        return x
    n = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfftfreq(n, 1 / rate)
    warp = lambda v: np.tan(np.pi * np.minimum(v, rate / 2 * 0.9999) / rate)
    w, a, b = warp(f), warp(np.array(low)), warp(np.array(high))
    s = np.divide(w * w - a * b, w * (b - a), out=np.full_like(w, np.inf), where=w > 0)
    with np.errstate(over="ignore"):
        gain = 1 / (1 + s ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x, n) * gain, n)[: len(x)]


def cancel_echo(x: np.ndarray, reference: np.ndarray | None = None, taps: int = 256, step: float = 0.01) -> np.ndarray:
    """What is left of x after an adaptive (least mean squares) prediction from the reference, by default from its own past."""
    ref = x if reference is None else reference
    w = np.zeros(taps)
    out = np.array(x, np.float64)
    for i in range(taps, min(len(x), len(ref))):
        past = ref[i - taps : i][::-1]
        out[i] = x[i] - w @ past
        w += step * out[i] * past
    return out


def enhance(x: np.ndarray, smoothing: float = 0.98) -> np.ndarray:
    """Gains from the ratio of signal to noise, smoothed over frames; the noise is that of the tenth with least energy."""
    s = stft(x)
    power = np.abs(s) ** 2
    energy = power.sum(1)
    quiet = np.argsort(energy, kind="stable")[: max(1, len(energy) // 10)]
    noise = power[quiet].mean(0) + 1e-10
    gain = np.empty_like(power)
    before = np.ones(power.shape[1])
    for i, p in enumerate(power):
        now = np.maximum(p / noise - 1, 0)
        ratio = now if i == 0 else smoothing * before + (1 - smoothing) * now
        gain[i] = np.sqrt(ratio / (1 + ratio))
        before = gain[i] ** 2 * p / noise
    return istft(s * gain, len(x))


def pre_emphasis(x: np.ndarray, k: float = 0.97) -> np.ndarray:
    return np.append(x[:1], x[1:] - k * x[:-1])


def normalise(x: np.ndarray, db: float = -20) -> np.ndarray:
    """x at so many decibels of root mean square, but with no sample above 0.99; near silence stays."""
    rms = np.sqrt(np.mean(x**2)) if len(x) else 0
    if rms < 1e-10:
        return x
    y = x * (10 ** (db / 20) / rms)
    peak = np.abs(y).max()
    return y * (0.99 / peak) if peak > 0.99 else y


def preprocess(x: np.ndarray, reduce: Callable[[np.ndarray], np.ndarray] = subtract_noise) -> np.ndarray:
    """Noise off (by subtraction or gate_noise), band kept, gains set, level set."""
    return normalise(enhance(band_pass(reduce(np.asarray(x, np.float64)))))


def applied(recordings: DataFrame, step: Callable[[np.ndarray], np.ndarray], samples: str = "samples") -> DataFrame:
    """recordings with their samples put through a function, row by row within Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else np.asarray(step(np.asarray(a, np.float64)), np.float32))

    return recordings.withColumn(samples, run(samples))


def mel_bank(bands: int = 128, size: int = FFT, rate: int = RATE) -> np.ndarray:
    """Triangles of equal area, evenly spaced on the mel scale that is linear up to 1 kHz."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1000) / 1000) / step)
    from_mel = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    p = from_mel(np.linspace(0, to_mel(np.array(rate / 2.0)), bands + 2))
    f = np.arange(size // 2 + 1) * rate / size
    up, down = (f[:, None] - p[:-2]) / (p[1:-1] - p[:-2]), (p[2:] - f[:, None]) / (p[2:] - p[1:-1])
    return np.maximum(0, np.minimum(up, down)) * (2 / (p[2:] - p[:-2]))


def _slopes(x: np.ndarray, width: int = 9) -> np.ndarray:
    """Slopes over time of a line through each nine frames, ends repeated."""
    half = width // 2
    k = np.arange(-half, half + 1)
    padded = np.pad(x, ((half, half), (0, 0)), mode="edge")
    return sum(c * padded[half + c : half + c + len(x)] for c in k) / (k**2).sum()


def frame_features(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One row of 76 numbers for each frame: 20 cepstral coefficients, their slopes and slopes of slopes, 12 chroma,
    spectral centroid and bandwidth, zero crossings, root mean square; weighted 1, .8, .5, .2, .3, .3, .1, .1."""
    x = np.asarray(x, np.float64)
    s = np.abs(stft(x))
    power = s**2
    mel = 10 * np.log10(np.maximum(1e-10, power @ mel_bank(rate=rate)))
    mel = np.maximum(mel, mel.max() - 80)
    n = mel.shape[1]
    dct = np.cos(np.pi / n * (np.arange(n)[:, None] + 0.5) * np.arange(20)) * np.sqrt(2 / n)
    dct[:, 0] /= np.sqrt(2)
    cepstra = mel @ dct
    f = np.arange(s.shape[1]) * rate / FFT
    pitch = np.round(12 * np.log2(np.maximum(f, 1e-6) / 440)).astype(int) % 12
    chroma = np.stack([power[:, (pitch == k) & (f > 30)].sum(1) for k in range(12)], 1)
    chroma /= np.maximum(chroma.max(1, keepdims=True), 1e-10)
    total = np.maximum(s.sum(1), 1e-10)
    centroid = s @ f / total
    width = np.sqrt((s * (f - centroid[:, None]) ** 2).sum(1) / total)
    padded = np.pad(x, FFT // 2, mode="edge")
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(padded, (0, max(0, FFT - len(padded)))), FFT)[::HOP][: len(s)]
    crossings = np.mean(np.signbit(frames[:, 1:]) != np.signbit(frames[:, :-1]), 1)
    rms = np.sqrt(np.mean(np.lib.stride_tricks.sliding_window_view(np.pad(x, (FFT // 2, FFT // 2 + FFT)), FFT)[::HOP][: len(s)] ** 2, 1))
    slopes = _slopes(cepstra)
    return np.hstack([cepstra, slopes * 0.8, _slopes(slopes) * 0.5, chroma * 0.2, centroid[:, None] * 0.3, width[:, None] * 0.3, crossings[:, None] * 0.1, rms[:, None] * 0.1])


def frames_of(recordings: DataFrame, key: str = "path") -> DataFrame:
    """(key, i, features, rms, db): a row for each frame of each recording."""
    kind = recordings.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for k, samples in zip(t[key], t["samples"]):
                x = np.asarray(samples, np.float64)
                f = frame_features(x)
                s = np.abs(stft(x))
                db = 20 * np.log10(np.maximum(s, 1e-5) / max(s.max(), 1e-5))
                yield pd.DataFrame({key: k, "i": np.arange(len(f)), "features": list(f), "rms": f[:, -1] * 10, "db": np.maximum(db, -80).mean(1)})

    return recordings.select(key, "samples").mapInPandas(run, f"{key} {kind}, i long, features array<double>, rms double, db double")


def quality_report(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs plus quality: ratios in decibels of the two signals' variances, two places.

    The two signal-to-noise figures compare a signal's variance with that of the signal without its mean, which is
    the same by definition, so they are 0; the reduction compares both signals.
    """
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def variance(c: Column) -> Column:
        a = F.transform(c, lambda x: x.cast("double"))
        m = mean(a)
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)

    v, w = variance(F.col(before)), variance(F.col(after))
    ratio = lambda a, b: F.bround(10 * F.log10((a + 1e-10) / (b + 1e-10)), 2)
    return pairs.withColumn("quality", F.struct(ratio(v, v).alias("snr_before"), ratio(w, w).alias("snr_after"), ratio(v, w).alias("noise_reduction_db")))

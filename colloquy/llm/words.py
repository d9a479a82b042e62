"""Words of texts as 64-bit hashes, computed for whole batches at once.

A word is a maximal run of letters, digits and underscores of the lower-cased text, in any script. Only these
hashes leave this module; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Characters beyond ASCII that are no part of a word.
_FOREIGN_GAP = re.compile(r"[^\x00-\x7f\w]")
#: ASCII bytes to themselves in lower case if they belong to words, else to 0; bytes of longer characters stay.
_CLASSES = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 0 for b in range(256))
_PERIOD = 4096
_SLICE = 4 << 20


def _powers() -> np.ndarray:
    out = np.empty(_PERIOD, np.uint64)
    out[:] = 0x9E3779B97F4A7C15
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def folded(text: str) -> bytes:
    """UTF-8 of the lower-cased text with byte 0 for whatever is no part of a word."""
    text = text.lower()
    if not text.isascii():
        text = _FOREIGN_GAP.sub("\0", text)
    return text.encode("utf-8", "replace").translate(_CLASSES)


def _hash_slice(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in raw, and their hashes. raw begins and ends between words."""
    b = np.frombuffer(raw, np.uint8)
    full = b != 0
    first = full.copy()
    first[1:] &= ~full[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    at = np.arange(starts[0], len(b), dtype=np.int64)
    at -= np.repeat(starts, np.diff(np.append(starts, len(b))))
    at &= _PERIOD - 1
    values = b[starts[0] :] * _POWERS[at]
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of texts[i] are hashes[offsets[i]:offsets[i + 1]]. None has no words."""
    parts, ends, found, length = [], [], [], 0
    total = 0
    offsets = np.zeros(len(texts) + 1, np.int64)

    def flush(upto: int) -> None:
        nonlocal total, length
        if parts:
            starts, hashes = _hash_slice(b"".join(parts))
            found.append(hashes)
            offsets[ends[0][0] + 1 : upto + 1] = total + np.searchsorted(starts, [e for _, e in ends], "left")
            total += len(hashes)
        parts.clear()
        ends.clear()
        length = 0

    for i, text in enumerate(texts):
        raw = folded(text or "") + b"\0"
        while len(raw) > _SLICE:  # a very long text goes through in pieces that end between words
            flush(i)
            cut = raw.rfind(b"\0", 0, _SLICE) + 1 or raw.find(b"\0") + 1
            starts, hashes = _hash_slice(raw[:cut])
            found.append(hashes)
            total += len(hashes)
            raw = raw[cut:]
        parts.append(raw)
        length += len(raw)
        ends.append((i, length))
        if length > _SLICE:
            flush(i + 1)
    flush(len(texts))
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), offsets


_ORDER = [np.uint64(c) for c in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; a shorter text has one run, of all its words."""
    n = len(hashes)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if n >= size else 0):
        runs += hashes[k : n - size + 1 + k] * _ORDER[k % 5] * np.uint64(2 * (k // 5) + 1)
    runs = mix(runs, 5)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            part = sum((hashes[a + k : a + k + 1] * _ORDER[k % 5] for k in range(b - a)), np.zeros(1, np.uint64))
            yield mix(part, b - a)
        else:
            yield np.empty(0, np.uint64)

"""Sets of word shingles as 64-bit hashes, computed with numpy for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the offsets of each text's words."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    blank = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True  # a text's first byte
    before = np.concatenate([[True], blank[:-1]]) | first[:-1]
    after = np.concatenate([blank[1:], [True]]) | first[1:]
    starts, stops = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    lengths = stops - starts
    out = np.full(len(starts), 17, np.uint64)
    alive, at = np.arange(len(starts)), 0
    coded = _LOWER[raw]
    while len(alive):
        out[alive] = (out[alive] + _CODES[coded[starts[alive] + at]]) * _STEP
        at += 1
        alive = alive[lengths[alive] > at]
    return mix(out), np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, n: int = 4) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; else none."""
    words, offsets = word_hashes(texts)
    total = len(words)
    rolled = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n if len(rolled) else 0):
        rolled = mix(rolled + words[k : total - n + 1 + k] * _STEP + np.uint64(k + 1))
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mix(h * _STEP + w + np.uint64(b - a + 100))
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed 64-bit numbers."""
    a = mix(grams * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    b = mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def least_hashes(grams: np.ndarray, k: int) -> list[int]:
    """The set's least value under k different hash functions."""
    return [int(mix(grams ^ np.uint64(0x51ED270B * (i + 1) + (i << 40))).min().astype(np.int64)) for i in range(k)]

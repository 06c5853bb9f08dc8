"""Words of Arrow text columns as NumPy arrays: places, hashes, shingles. No Python loop over words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROOT = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit moves every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT^i and ROOT^-i for i below n."""
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        for k, root in enumerate((ROOT, pow(ROOT, -1, 1 << 64))):
            steps = np.full(size, root, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]
    offsets: np.ndarray  # and the bytes offsets[i] to offsets[i + 1]


def words(texts: pa.Array) -> Words:
    """Words of each text; a null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = IS_WORD[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    start[filled] = inside[filled]
    end[filled[filled > 0] - 1] = inside[filled[filled > 0] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def hashes(w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with lower, A-Z count as a-z."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(w.data))
    total = np.empty(len(w.data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER if lower else BYTES)[w.data] * up, out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


# Fixed multipliers of the places in a sequence, from one rule.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, n <= 64, text ends not respected."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * PLACES[j]
    return mix(total)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; fewer words count as one shingle, none as no shingle."""
    w = words(texts)
    h = hashes(w, lower=True)
    s = sequences(h, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(s[a : b - n + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mix(np.array([(h[a:b] * PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Words, shingles and their hashes, vectorised over Arrow batches of whole texts.

A word is a run of bytes other than space and the controls 9 to 13, after A-Z became a-z. Its hash is a polynomial over
its bytes, taken as a difference of prefix sums, so no Python loop runs over words. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            t = np.full(n, b, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows; a null text has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = low != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    power, inverse = _power_tables(n + 1)
    terms = low.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; fewer words are one shingle, none is an empty set."""
    words, before = word_hashes(data, offsets)
    rolled = words * np.uint64(0xD6E8FEB86659FD93)
    for i in range(1, k):
        rolled = mix(rolled[:-1] if len(rolled) else rolled)
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[i : i + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * np.uint64(0xA0761D6478BD642F) + w)
            sets.append(h)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets

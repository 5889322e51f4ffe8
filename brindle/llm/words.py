"""Vectorised words and shingles of Arrow text columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. These bytes
are ASCII, so whole slices of UTF-8 are scanned as numpy bytes. A word is
hashed as a polynomial over a random value per byte, modulo 2^64, and mixed;
a shingle is a polynomial over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a uint64 array."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def random_u64(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = random_u64(256, 11)[_LOWER]  # a byte's value is that of its lower case
_VALUE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), _BASE)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of at most limit bytes, or one long text; of at most so many rows."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = hi if rows is None else min(hi, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return texts.cast(pa.large_string()).fill_null("")


@dataclass
class Words:
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end


#: Letters, digits and everything beyond ASCII; for words without punctuation.
PUNCTUATION = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def scan(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Words of concatenated texts; a word never crosses the bounds of a text. space: the bytes between words.

    Long data is scanned in parts that end between words, so that what is
    held for each byte does not grow with the text.
    """
    parts, lo = [], 0
    while lo < len(data):
        hi = _between(data, offsets, lo + SLICE_BYTES, space)
        bounds = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        parts.append((lo, *_scanned(data[lo:hi], bounds, space)))
        lo = hi
    if len(parts) == 1:
        _, starts, ends, hashes = parts[0]
    else:
        none = np.zeros(0, np.int64)
        starts, ends = (np.concatenate([none, *(p[0] + p[k] for p in parts)]) for k in (1, 2))
        hashes = np.concatenate([np.zeros(0, np.uint64), *(p[3] for p in parts)])
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def _between(data: np.ndarray, offsets: np.ndarray, at: int, space: np.ndarray) -> int:
    """The first place from at on where no word goes on: a byte between words, a text's bound, or the end."""
    if at >= len(data):
        return len(data)
    bound = int(offsets[np.searchsorted(offsets, at)])
    for lo in range(at, bound, 1 << 16):
        gaps = np.flatnonzero(space[data[lo : min(lo + (1 << 16), bound)]])
        if len(gaps):
            return lo + int(gaps[0])
    return bound


def _scanned(data: np.ndarray, bounds: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of data; a word also ends at bounds."""
    n = len(data)
    inside = ~space[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    spans = np.diff(starts, append=n)
    values = np.where(space, np.uint64(0), _VALUE)[data[starts[0] :]]
    values *= powers(int(spans.max()) + 1)[np.arange(starts[0], n) - np.repeat(starts, spans)]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    after = np.zeros(n + 1, bool)
    after[1:] = inside
    last = np.ones(n + 1, bool)
    last[:n] = ~inside
    last[bounds] = True
    return starts, np.flatnonzero(after & last), hashes


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): width-word shingles of each text; all its words as one if it has fewer."""
    h, first = words.hashes, words.first
    counts = np.diff(first)
    many = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate(([0], np.cumsum(many)))
    total = len(h)
    rolled = np.zeros(total, np.uint64)
    p = powers(width + 1)
    for j in range(min(width, total)):
        rolled[: total - j] += h[j:] * p[j]
    take = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], many)
    out = rolled[take]
    for k in np.flatnonzero((counts > 0) & (counts < width)):
        with np.errstate(over="ignore"):
            out[out_first[k]] = (h[first[k] : first[k + 1]] * p[: counts[k]]).sum(dtype=np.uint64) + np.uint64(counts[k])
    return mix(out), out_first

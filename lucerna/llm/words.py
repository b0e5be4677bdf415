"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Words are known by a 64-bit hash: its bytes,
eight at a time, are mixed with their place and summed, and the sum is mixed with the length, so words of up to eight bytes of one length
never share one. Sequences of any length are hashed in the same way. Only runs of a fixed, small number of words use powers of a base modulo
2^64, which roll along but which long runs of two alternating words could defeat. Everything is a few passes over
arrays, a slice of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_PLACE = _RANDOM.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(max(n, SLICE_BYTES + 64), base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def sequence_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each stretch of values, of the given sizes (one at least) one after the other: every value is mixed with its place."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(values)) - np.repeat(first, sizes)).astype(np.uint64)
    mixed = mix(values + mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return mix(np.add.reduceat(mixed, first) + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes data[start:end] (one byte at least), from its numbers of eight bytes."""
    sizes = -(-(ends - starts) // 8)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = np.repeat(starts - 8 * (np.cumsum(sizes) - sizes), sizes) + 8 * np.arange(int(sizes.sum()))
    left = np.minimum(8, np.repeat(ends, sizes) - at)
    values = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
    lengths = (ends - starts).astype(np.uint64)
    return mix(sequence_hashes(values, sizes) + lengths * np.uint64(0xA0761D6478BD642F))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end] of few values that depends on order, not on where the run is."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice of rows: first and end byte (in `data`), hash, and where each row's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: bytes of the texts, one after the other; offsets: where each begins, and the end."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | border))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border))
    hashes = byte_hashes(_LOWER[data], starts, ends)
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for stretches of an Arrow array of texts with about limit bytes each."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        base = offsets[start]
        yield start, end, find_words(data[base : offsets[end]], offsets[start : end + 1] - base)
        start = end


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words inside a row, and its row; a row with fewer words gives its whole run."""
    h, n = words.hashes, len(words.offsets) - 1
    counts = np.diff(words.rows)
    row_of = np.repeat(np.arange(n), counts)
    total = max(0, len(h) - size + 1)
    out = np.zeros(total, np.uint64)
    for k in range(size):
        out += h[k : k + total] * _PLACE[k]
    inside = row_of[:total] == row_of[size - 1 : size - 1 + total]
    out, rows = mix(out[inside]), row_of[:total][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sizes = counts[short]
        first = words.rows[short]
        whole = sequence_hashes(h[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes)
        at = np.searchsorted(rows, short)
        out, rows = np.insert(out, at, whole), np.insert(rows, at, short)
    return out, rows

"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Two different words or shingles share a hash with a probability of 2^-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
# Bytes hashed at a time; a longer word still stays whole.
WINDOW = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_PLACES = np.array([0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts and the last ends; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _hash_window(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; a word never crosses one of the positions ``breaks``."""
    inside = ~_space(raw)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    values = raw[at].astype(np.uint64)
    values[(values >= 65) & (values <= 90)] += np.uint64(32)
    values += np.uint64(1)
    values *= _powers(int(place.max()) + 1)[place]
    begins = np.flatnonzero(first[at])
    sums = np.add.reduceat(values, begins)
    lengths = np.diff(np.append(begins, len(at))).astype(np.uint64)
    return starts, mix(sums ^ (lengths * _GOLDEN))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the index of each text's first word (one entry more at the end)."""
    raw, ends = text_bytes(column)
    size, lo, starts, hashes = len(raw), 0, [], []
    while lo < size:
        hi = min(lo + WINDOW, size)
        while hi < size:  # move the cut to the next white space or text start
            ahead = raw[hi : hi + 65536]
            cuts = np.flatnonzero(_space(ahead))
            nearest = hi + int(cuts[0]) if len(cuts) else hi + len(ahead)
            text = np.searchsorted(ends, hi)
            if text < len(ends) and ends[text] <= nearest:
                hi = int(ends[text])
                break
            hi = nearest
            if len(cuts):
                break
        a, b = np.searchsorted(ends, [lo, hi])
        breaks = ends[a:b] - lo
        begun, hashed = _hash_window(raw[lo:hi], breaks[breaks < hi - lo])
        starts.append(begun + lo)
        hashes.append(hashed)
        lo = hi
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """For each text the sorted distinct hashes of its word shingles.

    A text of fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    words, first = word_hashes(column)
    if len(words) >= size:
        n = len(words) - size + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled += words[k : k + n] * _PLACES[k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            count = np.array([b - a], np.uint64)
            yield mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + count * _GOLDEN)
        else:
            yield np.zeros(0, np.uint64)

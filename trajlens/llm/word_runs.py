"""Words of texts as pointers into Arrow's text buffer, put in order by multikey quicksort.

A pointer is the byte at which a word starts. Pointers are compared by eight bytes
of their words at a time: large slices are cut in three around a pivot (smaller,
equal, larger), small ones are sorted outright, and what is equal in its eight bytes goes on with
the next eight. What is equal to the end is a run: one word. All steps keep the
given order of equal pointers, so a run is in the order of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from trajlens.llm.hashing import text_bytes

# Bytes of text whose pointers are sorted together; a longer text still stays whole.
SLICE_BYTES = 12 << 20
# Pointers that are sorted outright.
SMALL = 1 << 15


def letter_table() -> np.ndarray:
    """Byte to lower-case byte for A-Z, a-z and all bytes outside of ASCII; 0 for what parts words."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


LETTERS = letter_table()


@dataclass
class Words:
    """Lower-cased bytes of some texts with zeros between words, and where each word starts, ends and which text holds it."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    texts: np.ndarray

    def keys(self, which: np.ndarray, depth: int) -> np.ndarray:
        """Bytes ``depth`` to ``depth + 7`` of the words as one number; bytes after the end are zero."""
        at = np.minimum(self.starts[which] + depth, len(self.data) - 8)
        eight = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))
        left = np.clip(self.sizes[which] - depth, 0, 8).astype(np.uint64)
        unused = (np.uint64(8) - left) * np.uint64(8)
        found = eight[at].astype(np.uint64)
        # A shift by 64 bits is undefined, so an ended word is set apart.
        return np.where(left == 0, np.uint64(0), (found >> (unused & np.uint64(63))) << (unused & np.uint64(63)))


def words_in(raw: np.ndarray, ends: np.ndarray) -> Words:
    """The words of texts that lie one after the other in ``raw``; ``ends`` holds where each begins and the last ends."""
    data = np.zeros(len(raw) + 8, np.uint8)
    np.take(LETTERS, raw, out=data[: len(raw)])
    inside = data[: len(raw)] != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < len(raw)]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    texts = np.searchsorted(ends, starts, side="right") - 1
    return Words(data, starts, sizes.astype(np.int32), texts.astype(np.int32))


def _finish(words: Words, part: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A small slice in word order, and where in it a run begins. All its stretches of equal bytes go on together."""
    order, stretch = part.copy(), np.zeros(len(part), np.int64)
    begins = np.zeros(len(part), bool)
    begins[0] = True
    active = np.arange(len(part))
    while len(active):
        keys, within = words.keys(order[active], depth), stretch[active]
        place = np.lexsort((keys, within)) if within[-1] else np.argsort(keys, kind="stable")
        order[active], keys = order[active][place], keys[place]
        new = np.ones(len(active), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (within[1:] != within[:-1])
        begins[active[new]] = True
        group = np.cumsum(new) - 1
        stretch[active] = active[new][group]
        # A word that ends inside its eight bytes leaves the last of them zero.
        active = active[((keys & np.uint64(0xFF)) != 0) & (np.bincount(group)[group] > 1)]
        depth += 8
    return order, begins


def sorted_runs(words: Words, order: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """``order`` by word, and where in it a run of equal words begins; equal words keep the order they came in."""
    todo, placed, begins = [(order, 0)] if len(order) else [], [], []
    while todo:
        part, depth = todo.pop()
        if len(part) <= small:
            part, first = _finish(words, part, depth)
            placed.append(part)
            begins.append(first)
            continue
        keys = words.keys(part, depth)
        tried = np.sort(keys[:: max(1, len(keys) // 255)])
        pivot = tried[len(tried) // 2]
        below, above = keys < pivot, keys > pivot
        same = part[~(below | above)]
        todo.append((part[above], depth))
        if int(pivot) & 0xFF:
            todo.append((same, depth + 8))
            todo.append((part[below], depth))
        else:  # one word, ended; what is smaller has to come first
            if below.any():
                todo.append((same, depth))
                todo.append((part[below], depth))
            else:
                placed.append(same)
                begins.append(np.arange(len(same)) == 0)
        todo[:] = [t for t in todo if len(t[0])]
    if not placed:
        return order, np.zeros(0, bool)
    return np.concatenate(placed), np.concatenate(begins)


def slices_of(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of a batch's rows whose texts take about ``most`` bytes together."""
    _, ends = text_bytes(batch.column(text))
    begin = 0
    while begin < len(ends) - 1:
        stop = int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1
        stop = min(max(stop, begin + 1), len(ends) - 1)
        yield begin, stop
        begin = stop


def strings_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The given stretches of bytes as an Arrow string column."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def group_runs(raw: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Per word and group of texts: ``(word, group, occurrences, texts that hold it)``; ``groups`` gives each text's number."""
    words = words_in(raw, ends)
    group = groups[words.texts]
    order, begins = sorted_runs(words, np.argsort(group, kind="stable"))
    if not len(order):
        return pa.array([], pa.string()), order, order, order
    group, texts = group[order], words.texts[order]
    begins[1:] |= group[1:] != group[:-1]
    held = begins.copy()
    held[1:] |= texts[1:] != texts[:-1]
    at = np.flatnonzero(begins)
    counts = np.diff(np.append(at, len(order)))
    holding = np.add.reduceat(held.astype(np.int64), at)
    first = order[at]
    return strings_at(words.data, words.starts[first], words.sizes[first]), group[at], counts, holding

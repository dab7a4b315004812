"""Scoring of texts by a class-based bigram model.

Exchange clustering puts every word that training holds ``MIN_COUNT`` times or more
into one of a number of classes that grows with the cube root of the vocabulary:

1. A core of the most frequent words is clustered by moving one word at a time to the
   class that raises the likelihood of the class bigrams most.
2. Sweeps over all texts count, for each frequent word, the classes before and behind
   it; then each moves to its best class, while the class bigrams stand still.
3. One more sweep does so for all other words, in buckets of their hashes.

Rarer words form one further class, and the end of a text is a class of its own. The
probability of a token given the one before is

    P(class | class before) * P(word | class),

with the transition interpolated with the class's own frequency. Within the class of
rare words, emission is by absolute discounting, whose mass goes to words not seen in
training. As history, a word outside the frequent ones counts as one of that class.

Counts cover all training texts. They stay packed in buckets of the words' 64-bit
hashes, with the words' classes; only the counts of a bounded number of frequent words
are sent to all tasks. The other words of each text travel to their bucket with the
class before them, are looked up there, and come back as one partial sum per text and bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trajlens.llm.common import parallelism, stored
from trajlens.llm.hashing import word_hashes

# Words whose counts every task holds; words of the core, and the fewest classes.
FREQUENT, CLUSTERED, CLASSES = 50_000, 500, 24
# Occurrences from which on a word has a class; sweeps over the core, and over the texts for the frequent words.
MIN_COUNT = 3
SWEEPS, TEXT_SWEEPS = 6, 2
DISCOUNT, WEIGHT = 0.75, 20.0
# Distinct words that one task counts before it sends them on; (text, word) pairs it packs at a time.
HELD_WORDS, PACK_PAIRS = 3_000_000, 1_500_000
BUCKET_WORDS = 1_000_000
# Distinct (word, class beside it) cells that one task holds; frequent words that are moved in one group.
HELD_CELLS, SLICE_WORDS = 2_000_000, 500
# Groups over which the tasks' class bigrams of frequent words are spread before they are added up.
SPREAD = 256

_COUNTS = "bucket int, words binary, counts binary"
_SUMS = ("rows", "known", "base", "emitted")
_PARTIAL = "part int, " + ", ".join(f"{c} binary" for c in _SUMS)
_RARE = "bucket int, words binary, texts binary, before binary, times binary"
_BESIDE = "bucket int, words binary, beside binary, n binary"
_CLASSED = "bucket int, words binary, counts binary, labels binary, cells binary, n binary"


def _split(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each of the sorted words, and where each bucket starts (one entry more at the end)."""
    buckets = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    present, starts = np.unique(buckets, return_index=True)
    return present, np.append(starts, len(words))


def count_words(texts: DataFrame, bits: int) -> DataFrame:
    """``(bucket, words, counts)``: sorted word hashes and their numbers, one row per bucket."""

    def count(batches):
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def rows(words, counts):
            present, edges = _split(words, bits)
            cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(present, pa.int32()),
                    pa.array([words[a:b].tobytes() for a, b in cut], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in cut], pa.binary()),
                ],
                names=["bucket", "words", "counts"],
            )

        for batch in batches:
            for at in range(0, len(batch), 1000):
                hashes, _ = word_hashes(batch.column(0).slice(at, 1000))
                new, n = np.unique(hashes, return_counts=True)
                words.append(new)
                counts.append(n)
                if sum(map(len, words[1:])) >= HELD_WORDS // 2:
                    words, counts = ([x] for x in _merged(words, counts))
                if len(words[0]) >= HELD_WORDS:
                    yield rows(words[0], counts[0])
                    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        merged = _merged(words, counts)
        if len(merged[0]):
            yield rows(*merged)

    def merge(key, table):
        words, counts = _merged(
            [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()],
            [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()],
        )
        return pa.table(
            {"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}
        )

    return texts.mapInArrow(count, _COUNTS).groupBy("bucket").applyInArrow(merge, _COUNTS)


def _merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, inverse = np.unique(np.concatenate(words), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate(counts).astype(float), len(every)).astype(np.int64)


def _totals(counts: DataFrame) -> tuple[int, int, list[tuple[int, int]]]:
    """Tokens, distinct words, and how many words have each count band, from the highest on: ``(least count, words)``."""

    def bands(batches):
        for batch in batches:
            for packed in batch.column("counts").to_pylist():
                n = np.frombuffer(packed, np.int64)
                band = np.floor(np.log2(n) * 16).astype(np.int64)
                found, at = np.unique(band, return_inverse=True)
                least = np.full(len(found), np.iinfo(np.int64).max)
                np.minimum.at(least, at, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(least), pa.array(np.bincount(at)), pa.array(np.bincount(at, n).astype(np.int64))],
                    names=["band", "least", "words", "tokens"],
                )

    spread = (
        counts.select("counts")
        .mapInArrow(bands, "band long, least long, words long, tokens long")
        .groupBy("band")
        .agg(F.min("least").alias("least"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
        .orderBy(F.desc("band"))
        .collect()
    )
    return sum(r["tokens"] for r in spread), sum(r["words"] for r in spread), [(r["least"], r["words"]) for r in spread]


def _frequent(counts: DataFrame, bands: list[tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words: whole count bands while they fit into ``most``.

    If the first band alone doesn't fit, its words are taken by hash, so that at least half of the room is used.
    """
    taken, least = 0, None
    for count, words in bands:
        if taken + words > most:
            break
        taken, least = taken + words, count
    below = np.uint64(2**64 - 1)
    if least is None:
        if not bands:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        least, below = bands[0][0], np.uint64(int(2**64 * 0.75 * most / bands[0][1]))

    def pick(batches):
        for batch in batches:
            for words, packed in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(packed, np.int64)
                keep = (n >= least) & (np.frombuffer(words, np.uint64) <= below)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(words, np.int64)[keep]), pa.array(n[keep])], names=["word", "n"]
                )

    found = counts.select("words", "counts").mapInArrow(pick, "word long, n long").toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found.column("n").to_numpy()[order]


def _symbols(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash among the sorted words, -1 where it isn't one of them."""
    if not len(words):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def _bigrams(texts: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each clustered word, any other word, or a text's end follows another.

    The last two rows and columns stand for other words and for the end, which also comes before the first word.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words.tobytes())

    def count(batches):
        known = np.frombuffer(shared.value, np.uint64)
        size = len(known) + 2
        found = np.zeros(size * size, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                hashes, first = word_hashes(batch.column(0).slice(at, 1000))
                symbols = _symbols(known, hashes)
                symbols[symbols < 0] = size - 2
                sequence = np.insert(symbols, first[1:], size - 1)  # an end behind each text
                before = np.concatenate(([size - 1], sequence[:-1]))
                found += np.bincount(before * size + sequence, minlength=size * size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["cell", "n"])

    cells = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    size = len(words) + 2
    matrix = np.zeros(size * size)
    matrix[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return matrix.reshape(size, size)


def exchange_classes(bigrams: np.ndarray, counts: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each word of a bigram matrix whose last two symbols (other words, end) keep classes of their own.

    Words start round robin by frequency. In each sweep every word, the most
    frequent first, moves to the class with the highest likelihood; it stops
    when no word moves. The likelihood of class bigrams is the sum of n log n over class pairs
    minus that over the classes' left and right totals.
    """
    n_words = len(bigrams) - 2
    order = np.argsort(-counts, kind="stable")
    label = np.empty(n_words + 2, np.int64)
    label[order] = np.arange(n_words) % max(1, min(classes, n_words))
    label[n_words:] = classes, classes + 1
    k = classes + 2
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    rows = np.zeros((len(bigrams), k))  # counts of word -> class
    columns = np.zeros((k, len(bigrams)))  # counts of class -> word
    np.add.at(rows.T, label, bigrams.T)
    np.add.at(columns, label, bigrams)
    table = np.zeros((k, k))
    np.add.at(table, label, rows)
    for _ in range(sweeps):
        moved = 0
        for word in order.tolist():
            old, self_count = label[word], bigrams[word, word]
            out, into = rows[word].copy(), columns[:, word].copy()
            out[old] -= self_count
            into[old] -= self_count
            # Take the word out, then compare the gain of each class that could take it.
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= self_count
            left, right = table.sum(axis=1), table.sum(axis=0)
            gain_rows = (xlogx(table + out) - xlogx(table)).sum(axis=1)
            gain_columns = (xlogx(table + into[:, None]) - xlogx(table)).sum(axis=0)
            corner = table.diagonal()
            both = xlogx(corner + out + into + self_count) - xlogx(corner + out) - xlogx(corner + into) + xlogx(corner)
            sides = xlogx(left + out.sum() + self_count) - xlogx(left) + xlogx(right + into.sum() + self_count) - xlogx(right)
            gain = (gain_rows + gain_columns + both - sides)[:classes]
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += out
            table[:, new] += into
            table[new, new] += self_count
            if new != old:
                moved += 1
                label[word] = new
                rows[:, old] -= bigrams[:, word]
                rows[:, new] += bigrams[:, word]
                columns[old] -= bigrams[word]
                columns[new] += bigrams[word]
        if not moved:
            break
    return label


def best_classes(table: np.ndarray, word: np.ndarray, beside: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class of most likelihood for each word, by the classes beside it, while ``table`` stands still.

    ``table`` counts class bigrams; its last two classes (rare words, end) take no words.
    ``word`` numbers the words in ascending order, ``beside`` is a class before the
    word, or one behind it plus the number of all classes, and ``n`` how often it
    is there. ``old`` is each word's present class, which is compared without the word.
    """
    size = len(table)
    classes = size - 2
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    grow = lambda have, more: xlogx(have + more) - xlogx(have)
    both = np.concatenate((table[:, :classes], table[:classes].T))  # a row per class beside, a column per class to take
    sides = (table.sum(axis=0)[:classes], table.sum(axis=1)[:classes])
    best = np.zeros(len(old), np.int64)
    starts = np.searchsorted(word, np.arange(len(old) + 1))
    at = 0
    while at < len(old):
        # As many words as keep the cells x classes matrix near two million numbers, one at least.
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + 2_000_000 // max(classes, 1), "right")) - 1)
        end = min(end, len(old))
        a, b = starts[at], starts[end]
        mine, count = word[a:b] - at, n[a:b].astype(float)
        stays = old[at:end] < classes
        have = both[beside[a:b]]
        own = np.flatnonzero(stays[mine])
        have[own, old[at:end][mine[own]]] -= count[own]
        gain = np.zeros((end - at, classes))
        filled = np.flatnonzero(starts[at + 1 : end + 1] > starts[at:end])
        if len(filled):
            gain[filled] = np.add.reduceat(grow(np.maximum(have, 0), count[:, None]), starts[at + filled] - a, axis=0)
        for side, total in enumerate(sides):
            here = np.bincount(mine, count * ((beside[a:b] >= size) == bool(side)), end - at)
            standing = np.repeat(total[None, :], end - at, axis=0)
            standing[np.flatnonzero(stays), old[at:end][stays]] -= here[stays]
            gain -= grow(np.maximum(standing, 0), here[:, None])
        best[at:end] = gain.argmax(axis=1)
        at = end
    return best


def _sequence(column: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all tokens of some texts with an end behind each, those before them, and the tokens' hashes.

    Words outside ``words`` have the symbol ``len(words)``, ends the next one, which also comes before each text.
    """
    hashes, first = word_hashes(column)
    symbols = _symbols(words, hashes)
    symbols[symbols < 0] = len(words)
    sequence = np.insert(symbols, first[1:], len(words) + 1)
    return sequence, np.concatenate(([len(words) + 1], sequence[:-1])), np.insert(hashes, first[1:], 0)


def _beside(sequence: np.ndarray, before: np.ndarray, label: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of tokens, and the class beside each: before all tokens that are asked for, and behind them."""
    size = int(label[-1]) + 1  # the end has the last class
    at = np.flatnonzero(asked)
    behind = at[at + 1 < len(sequence)]
    return np.concatenate((at, behind)), np.concatenate((label[before[at]], size + label[sequence[behind + 1]]))


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
    order = np.argsort(codes, kind="stable")  # fast for a few sorted runs
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def _frequent_cells(texts: DataFrame, words: np.ndarray, label: np.ndarray) -> DataFrame:
    """``(code, n)``: how often each frequent word, other word or end has each class before or behind it.

    The code is the symbol times twice the number of classes, plus the class beside it as in ``best_classes``.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words.tobytes(), label.tobytes()))

    def count(batches):
        known, labels = np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.int64)
        width = 2 * (int(labels[-1]) + 1)
        summed, fresh, total = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                sequence, before, _ = _sequence(batch.column(0).slice(at, 1000), known)
                where, beside = _beside(sequence, before, labels, np.ones(len(sequence), bool))
                fresh.append(sequence[where] * width + beside)
                total += len(where)
                if total >= 2 * HELD_CELLS:
                    codes, n = np.unique(np.concatenate(fresh), return_counts=True)
                    summed, fresh, total = _summed([summed[0], codes], [summed[1], n]), [], 0
                    if len(summed[0]) >= HELD_CELLS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed], names=["code", "n"])
                        summed = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if fresh:
            codes, n = np.unique(np.concatenate(fresh), return_counts=True)
            summed = _summed([summed[0], codes], [summed[1], n])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed], names=["code", "n"])

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _class_table(cells: DataFrame, size: int) -> np.ndarray:
    """The matrix of class bigrams from ``(cell, n)``, whose sums are at most one row per pair of classes."""
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size, size)


def _sweep(texts: DataFrame, words: np.ndarray, counts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The classes of the frequent words (and of other words and ends) after all have moved at once."""
    size = int(label[-1]) + 1
    width = 2 * size
    cells = stored(_frequent_cells(texts, words, label))
    shared = texts.sparkSession.sparkContext.broadcast(label.tobytes())

    def pairs(batches):
        labels = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            code, n = code[code % width < size], n[code % width < size]
            cell, at = np.unique(code % width * size + labels[code // width], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(at, n, len(cell)).astype(np.int64))], names=["cell", "n"])

    table = _class_table(cells.mapInArrow(pairs, "cell long, n long"), size)
    standing = texts.sparkSession.sparkContext.broadcast(table.tobytes())

    def move(key, part):
        code, n = part.column("code").to_numpy(), part.column("n").to_numpy()
        order = np.argsort(code)
        code, n = code[order], n[order]
        symbol, word = np.unique(code // width, return_inverse=True)
        old = np.frombuffer(shared.value, np.int64)[symbol]
        matrix = np.frombuffer(standing.value).reshape(size, size)
        return pa.table({"symbol": symbol, "label": best_classes(matrix, word, code % width, n, old)})

    moved = (
        cells.where(F.col("code") < len(words) * width)
        .withColumn("slice", F.floor(F.col("code") / (width * SLICE_WORDS)))
        .groupBy("slice")
        .applyInArrow(move, "symbol long, label long")
        .toArrow()
    )
    after = label.copy()
    after[moved.column("symbol").to_numpy()] = moved.column("label").to_numpy()
    after[: len(words)][counts < MIN_COUNT] = size - 2
    return after


def _classify_rest(texts: DataFrame, counts: DataFrame, words: np.ndarray, label: np.ndarray, bits: int) -> DataFrame:
    """The buckets of ``counts`` with a class for every word outside the frequent ones, and class bigrams.

    Rows with a bucket below zero hold the class bigrams of the frequent words alone.
    """
    size = int(label[-1]) + 1
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((words.tobytes(), label.tobytes()))

    def collect(batches):
        known, labels = np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.int64)
        table = np.zeros(size * size, np.int64)
        held, total = [], 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                sequence, before, hashes = _sequence(batch.column(0).slice(at, 1000), known)
                rare = sequence == len(known)
                table += np.bincount((labels[before] * size + labels[sequence])[~rare], minlength=size * size)
                where, beside = _beside(sequence, before, labels, rare)
                held.append((beside, hashes[where]))
                total += len(where)
                if total >= PACK_PAIRS:
                    yield _packed_by_bucket(held, bits, _BESIDE_NAMES, (np.uint16, np.uint32))
                    held, total = [], 0
        if total:
            yield _packed_by_bucket(held, bits, _BESIDE_NAMES, (np.uint16, np.uint32))
        at = np.flatnonzero(table)
        bucket = -1 - TaskContext.get().partitionId() % SPREAD
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (np.zeros(0, np.uint64), at, table[at])]],
            names=["bucket", *_BESIDE_NAMES],
        )

    beside = texts.mapInArrow(collect, _BESIDE)
    # The class bigrams that the words are compared with: those of the frequent words, all others being one class.
    before = stored(beside)
    names = ["bucket", "words", "counts", "labels", "cells", "n"]

    def row(bucket, *values):
        return pa.table(
            [pa.array([bucket], pa.int32()), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values]], names=names
        )

    def rest_pairs(batches):
        labels_rest = size - 2
        for batch in batches:
            for bucket, cell, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "beside", "n"))):
                if bucket < 0:
                    at, n = np.frombuffer(cell, np.int64), np.frombuffer(n, np.int64)
                else:
                    at, n = np.frombuffer(cell, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32)
                    at, n = at[at < size] * size + labels_rest, n[at < size]
                at, inverse = np.unique(at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(inverse, n, len(at)).astype(np.int64))], names=["cell", "n"])

    table = _class_table(before.mapInArrow(rest_pairs, "cell long, n long"), size)
    standing = spark.sparkContext.broadcast(table.tobytes())

    def classify(key, held, found):
        bucket = (held if held.num_rows else found).column("bucket")[0].as_py()
        none = np.zeros(0, np.int64)
        if bucket < 0:
            at, n = ([np.frombuffer(x, np.int64) for x in found.column(c).to_pylist()] for c in ("beside", "n"))
            return row(bucket, none, none, none.astype(np.uint16), *_summed(at, n))
        counted, times = (np.frombuffer(held.column(c)[0].as_py(), k) for c, k in (("words", np.uint64), ("counts", np.int64)))
        labels = np.full(len(counted), size - 2, np.int64)
        met, beside, n = (
            np.concatenate([np.frombuffer(x, k) for x in found.column(c).to_pylist()] or [np.zeros(0, k)])
            for c, k in (("words", np.uint64), ("beside", np.uint16), ("n", np.uint32))
        )
        word = np.searchsorted(counted, met)
        code, n = _summed([word * (2 * size) + beside], [n])
        word, beside = code // (2 * size), code % (2 * size)
        often = times[word] >= MIN_COUNT
        index, local = np.unique(word[often], return_inverse=True)
        labels[index] = best_classes(np.frombuffer(standing.value).reshape(size, size), local, beside[often], n[often], labels[index])
        first = beside < size
        cells = _summed([beside[first] * size + labels[word[first]]], [n[first]])
        return row(bucket, counted, times, labels.astype(np.uint16), *cells)

    return stored(counts.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(classify, _CLASSED))


class ClassModel:
    """Log10 probabilities of the class bigrams and what the emissions need."""

    def __init__(self, label: np.ndarray, bigrams: np.ndarray, clustered: np.ndarray, tokens: int, words: int):
        k = label.max() + 1
        table = np.zeros((k, k))
        np.add.at(table, (label[:, None], label[None, :]), bigrams)
        # The class of rare words: its tokens, its distinct words, and the mass set aside for unseen words.
        self._learn(table, tokens - float(clustered.sum()), words - len(clustered))

    @classmethod
    def of_table(cls, table: np.ndarray, rest_words: int) -> "ClassModel":
        """The model of a matrix of class bigrams, whose last but one class has ``rest_words`` distinct words."""
        model = cls.__new__(cls)
        model._learn(table, float(table[:, -2].sum()), rest_words)
        return model

    def _learn(self, table: np.ndarray, rest_tokens: float, rest_words: int) -> None:
        k = len(table)
        own = (table.sum(axis=0) + 1) / (table.sum() + k)
        self.transition = np.log10((table + WEIGHT * own) / (table.sum(axis=1, keepdims=True) + WEIGHT))
        self.size = table.sum(axis=0)
        self.rest_tokens, self.rest_words = max(rest_tokens, 1.0), max(rest_words, 1)

    def emission(self, counts: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Log10 probability of words in their classes."""
        inside = label < len(self.size) - 2
        return np.where(inside, np.log10(np.maximum(counts, 1) / np.maximum(self.size[label], 1)), self.rest(counts))

    def rest(self, counts: np.ndarray) -> np.ndarray:
        """Log10 emission of words without a class; all unseen words count as one."""
        seen = np.maximum(counts - DISCOUNT, 1e-300) / self.rest_tokens
        unseen = max(DISCOUNT * self.rest_words / self.rest_tokens, 1.0 / (self.rest_tokens + 1))
        return np.log10(np.where(counts > 0, seen, min(unseen, 1.0)))


@dataclass
class Fitted:
    """What training leaves: ``classed`` holds ``(bucket, words, counts, labels)`` of all words, packed by word hash."""

    classed: DataFrame
    bits: int
    frequent: np.ndarray
    frequent_n: np.ndarray
    label: np.ndarray  # of the frequent words, any other word, and ends
    model: ClassModel
    tokens: int
    kinds: int
    n_texts: int


def fit_classes(training: DataFrame, text_col: str = "text") -> Fitted:
    """Count, cluster and learn from the whole texts of a column; a null text counts as the empty one."""
    texts = training.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars, n_texts = texts.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    bits = max(0, int(chars or 0) // (20 * BUCKET_WORDS)).bit_length()
    counts = stored(count_words(texts, bits))
    word_tokens, word_kinds, bands = _totals(counts)
    frequent, frequent_n = _frequent(counts, bands, FREQUENT)
    clustered_kinds = sum(words for least, words in bands if least >= MIN_COUNT)
    classes = max(CLASSES, math.ceil(clustered_kinds ** (1 / 3)))
    top = np.sort(np.argsort(-frequent_n, kind="stable")[: max(CLUSTERED, 2 * classes)])
    core = exchange_classes(_bigrams(texts, frequent[top]), frequent_n[top], classes)
    label = np.append(np.full(len(frequent) + 1, classes), classes + 1)
    label[top] = core[:-2]
    for _ in range(TEXT_SWEEPS):
        label = _sweep(texts, frequent, frequent_n, label)
    classed = _classify_rest(texts, counts, frequent, label, bits)
    model = ClassModel.of_table(_class_table(classed.mapInArrow(_cells, "cell long, n long"), classes + 2), word_kinds - clustered_kinds)
    return Fitted(
        classed.where("bucket >= 0").select("bucket", "words", "counts", "labels"),
        bits,
        frequent,
        frequent_n,
        label,
        model,
        word_tokens + n_texts,
        word_kinds + (n_texts > 0),
        n_texts,
    )


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Learns from the text column of ``training``. Tokens are words, A-Z lower-cased,
    and one end per text. ``base_score`` sums log10((c + 1) / (N + 1 * (V + 1))) over
    the tokens; ``score`` is the class model's log10 probability of the text.

    * Null or blank text: its end alone. Null id and repeated rows: passed on, one result per row.
    * Very long text: read whole, in windows of bytes.
    * No training rows: all tokens are unknown. Empty table: empty result. Other columns are ignored.
    """
    fitted = fit_classes(training, text_col)
    bits, frequent, frequent_n, label, model = fitted.bits, fitted.frequent, fitted.frequent_n, fitted.label, fitted.model
    tokens, kinds, n_texts = fitted.tokens, fitted.kinds, fitted.n_texts
    base = lambda c: np.log10((c + 1) / (tokens + 1 * (kinds + 1)))
    base_frequent, base_end = base(frequent_n.astype(float)), float(base(float(n_texts)))
    emission = model.emission(frequent_n.astype(float), label[:-2])
    shared = docs.sparkSession.sparkContext.broadcast(
        (frequent.tobytes(), base_frequent.tobytes(), emission.tobytes(), label.tobytes(), model.transition.tobytes())
    )
    learned = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows that agree in id and text share a key and are asked for once; different ones do so with a chance of 2^-64.
    numbered = source.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")

    kind = source.schema["doc_id"].dataType.simpleString()
    sums_of = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    schema = T.StructType.fromDDL(f"{sums_of}, {_RARE}")
    arrow = to_arrow_schema(schema)

    def local(batches):
        """Rows with the sums over what every task knows, and rows with the other words of the texts, by bucket."""
        words, bases, emissions, labels, transition = (
            np.frombuffer(x, k) for x, k in zip(shared.value, (np.uint64, float, float, np.int64, float))
        )
        n_classes = int(labels[-1]) + 1
        transition = transition.reshape(n_classes, n_classes)
        # Words outside the frequent ones add nothing here; the end has its base score and no emission.
        bases, emissions = np.append(bases, (0.0, base_end)), np.append(emissions, (0.0, 0.0))
        held: list[tuple[np.ndarray, ...]] = []
        total, met = 0, set()

        def padded(batch):
            given = {name: batch.column(name) for name in batch.schema.names}
            columns = [given[f.name].cast(f.type) if f.name in given else pa.nulls(len(batch), f.type) for f in arrow]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sequence, before, hashes = _sequence(part.column("text"), words)
                lengths = np.diff(np.flatnonzero(np.append(True, sequence == len(words) + 1)))
                text = np.repeat(np.arange(len(part)), lengths)
                rare = sequence == len(words)
                steps = np.where(rare, 0.0, transition[labels[before], labels[sequence]])
                n_known = np.bincount(text, sequence < len(words), len(part)).astype(np.int64) + (n_texts > 0)
                b, e = (np.bincount(text, v, len(part)) for v in (bases[sequence], steps + emissions[sequence]))
                yield padded(
                    pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("doc_id"), pa.array(lengths), pa.array(n_known), pa.array(b), pa.array(e)],
                        names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score"],
                    )
                )
                fresh = np.array([key not in met and not met.add(key) for key in part.column("row").to_pylist()], bool)
                ask = np.flatnonzero(rare & fresh[text])
                held.append((part.column("row").to_numpy()[text[ask]], labels[before[ask]], hashes[ask]))
                total += len(ask)
                if total >= PACK_PAIRS:
                    yield padded(_packed_by_bucket(held, bits, _RARE_NAMES, (np.int64, np.uint16, np.uint32)))
                    held, total, met = [], 0, set()
        if total:
            yield padded(_packed_by_bucket(held, bits, _RARE_NAMES, (np.int64, np.uint16, np.uint32)))

    scored = stored(numbered.mapInArrow(local, schema))
    known = scored.where("bucket IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base_score", "score")
    rare = scored.where("bucket IS NOT NULL").select("bucket", *_RARE_NAMES)

    def look_up(key, held, asked):
        words, n, labels = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        if held.num_rows:
            words, n, labels = (
                np.frombuffer(held.column(c)[0].as_py(), k) for c, k in (("words", np.uint64), ("counts", np.int64), ("labels", np.uint16))
            )
        rows, hashes, before, times = (
            np.concatenate([np.frombuffer(x, k) for x in asked.column(c).to_pylist()] or [np.zeros(0, k)])
            for c, k in (("texts", np.int64), ("words", np.uint64), ("before", np.uint16), ("times", np.uint32))
        )
        order = np.lexsort((before, hashes, rows))
        rows, hashes, before, times = rows[order], hashes[order], before[order], times[order]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]) | (before[1:] != before[:-1])
        rows, hashes, before, times = rows[once], hashes[once], before[once], times[once]
        at = _symbols(words, hashes)
        model = learned.value
        c, label = np.zeros(len(at)), np.full(len(at), len(model.size) - 2)
        found = np.flatnonzero(at >= 0)
        c[found], label[found] = n[at[found]], labels[at[found]]
        emitted = model.transition[before, label] + model.emission(c, label)
        sums = (rows, times * (c > 0), times * base(c), times * emitted)
        return _by_part(*_added(*sums), parts)

    def add_up(key, table):
        packed = (
            np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()])
            for c, k in zip(_SUMS, (np.int64, np.float64, np.float64, np.float64))
        )
        row, known, base_sum, emitted = _added(*packed)
        return pa.table({"row": row, "known": known.astype(np.int64), "base": base_sum, "emitted": emitted})

    parts = parallelism(docs)
    looked_up = fitted.classed.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(look_up, _PARTIAL)
    sums = looked_up.groupBy("part").applyInArrow(add_up, "row long, known long, base double, emitted double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return known.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("base")).alias("base_score"),
        (F.col("score") + zero("emitted")).alias("score"),
    )


def _added(rows: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct rows and the sums of their values."""
    every, inverse = np.unique(rows, return_inverse=True)
    return [every, *[np.bincount(inverse, v, len(every)) for v in values]]


def _by_part(rows: np.ndarray, known: np.ndarray, base: np.ndarray, emitted: np.ndarray, parts: int) -> pa.Table:
    """A bucket's sums, packed for the part of the table that each row belongs to."""
    part = (rows.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    present, starts = np.unique(part[order], return_index=True)
    cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
    packed = {
        name: pa.array([values[order[a:b]].tobytes() for a, b in cut], pa.binary())
        for name, values in zip(_SUMS, (rows, known, base, emitted))
    }
    return pa.table({"part": pa.array(present, pa.int32()), **packed})


_BESIDE_NAMES = ("words", "beside", "n")
_RARE_NAMES = ("words", "texts", "before", "times")


def _cells(batches):
    """``(cell, n)`` of all class bigrams that are packed in buckets."""
    for batch in batches:
        for cells, n in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (cells, n)], names=["cell", "n"])


def _packed_by_bucket(held: list[tuple[np.ndarray, ...]], bits: int, names: tuple, kinds: tuple) -> pa.RecordBatch:
    """Distinct keys, the last of whose columns is a word, and how often each occurs, by the word's bucket."""
    columns = [np.concatenate(x) for x in zip(*held)]
    if len(columns) > 2:  # texts come in order, so one number sorts them and the class
        text = np.cumsum(np.append(False, columns[0][1:] != columns[0][:-1]))[: len(columns[0])]
        order = np.lexsort((text * 2**16 + columns[1], columns[2]))
    else:
        order = np.lexsort(columns)
    columns = [x[order] for x in columns]
    fresh = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in columns], axis=0))) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    *others, words = (x[at] for x in columns)
    values = [words, *others, np.diff(np.append(at, len(order)))]
    values = [words, *[v.astype(k) for v, k in zip(values[1:], kinds)]]
    present, edges = _split(words, bits)
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int32()), *[pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in values]],
        names=["bucket", *names],
    )

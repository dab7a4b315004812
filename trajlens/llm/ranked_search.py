"""Ranked lexical search by a dual tree, with exact integer scores.

Documents are read once: each becomes the counts of those words that an item uses,
and its length. Weights of words follow from these counts.

Items and documents are then searched together. Items with common rare words form
groups, groups form larger ones; a task's documents form blocks, blocks of blocks.
Every node holds the largest value of each word (coordinate) among its members, so
the product of an item node and a document node is at least any score between them.
If it is below the weakest kth score among the node's items, no document of the node
can enter any list of these items, and the whole batch of pairs ends there. Both
trees are descended together, level by level, and pairs that are left at the end are
scored as integers.

A task starts from the kth scores that a share of the documents gave (1 of
``SEED_SHARE`` by hash). They are true scores, so they are bounds from below for any
result; they only save work. All documents are searched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import stored, text_of

TOP = 20
# Members per node at each level, items and documents, from the leaves up.
ITEM_FAN, DOC_FAN = (8, 8), (16, 8, 8)
# Distinct words of the items that are searched together, documents a task searches at a time, cells of one dense table.
BATCH_TERMS, TASK_DOCS, CELLS = 200_000, 8_192, 1 << 21
SEED_SHARE = 32
# Room for rounding in sums of doubles; scores themselves are integers.
SLACK = 1.0 + 1e-9

_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 0x20
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters outside of ASCII; A-Z lower-cased."""
    return text.encode().translate(_BYTES).split() if text else []


@dataclass
class ItemNode:
    """Items below this node, the words they use, and per child the largest weighted count of each word."""

    items: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    children: list[ItemNode] = field(default_factory=list)


def _join_nodes(children: list[ItemNode]) -> ItemNode:
    terms = np.unique(np.concatenate([c.terms for c in children]))
    values = np.zeros((len(children), len(terms)), np.int64)
    for i, child in enumerate(children):
        values[i, np.searchsorted(terms, child.terms)] = child.values.max(axis=0)
    return ItemNode(np.concatenate([c.items for c in children]), terms, values, children)


def item_tree(items: list[dict[int, int]]) -> list[ItemNode]:
    """Top nodes over items given as ``{word number: count * weight}``; neighbours share their heaviest common word."""
    used = np.bincount([t for item in items for t in item] or [0])

    def place(i: int) -> tuple:
        shared = [(-w, t) for t, w in items[i].items() if used[t] > 1]
        return min(shared, default=(0, -1))[1], i

    nodes = []
    for i in sorted((i for i, item in enumerate(items) if any(item.values())), key=place):
        terms = np.array(sorted(items[i]), np.int64)
        nodes.append(ItemNode(np.array([i]), terms, np.array([[items[i][t] for t in terms.tolist()]], np.int64)))
    for fan in ITEM_FAN:
        nodes = [_join_nodes(nodes[at : at + fan]) for at in range(0, len(nodes), fan)]
    return nodes


class Block:
    """Some documents as (document, word, value) entries by word, opened as a dense table for the words of an item node."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        order = np.argsort(terms, kind="stable")
        self.docs, self.values, self.size = docs[order], values[order], size
        self.terms, self.begin = np.unique(terms[order], return_index=True)
        self.end = np.append(self.begin[1:], len(terms))
        self.most = np.maximum.reduceat(self.values, self.begin) if len(terms) else values

    def bound(self, node: ItemNode) -> float:
        """At least the score of any document and any item of the node."""
        _, mine, theirs = np.intersect1d(self.terms, node.terms, assume_unique=True, return_indices=True)
        return float((node.values.max(axis=0)[theirs].astype(float) * self.most[mine]).sum())

    def table(self, terms: np.ndarray) -> np.ndarray:
        """Documents x words; documents are filled up to whole nodes of every level."""
        _, mine, theirs = np.intersect1d(self.terms, terms, assume_unique=True, return_indices=True)
        counts = self.end[mine] - self.begin[mine]
        entries = np.repeat(self.begin[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        dense = np.zeros((-(-self.size // DOC_FAN[0]) * DOC_FAN[0], len(terms)))
        dense[self.docs[entries], np.repeat(theirs, counts)] = self.values[entries]
        return dense


class Search:
    """The best documents of every item so far, and the search that improves them."""

    def __init__(self, count: int, floors: np.ndarray, top: int):
        self.floors, self.top = floors, top
        self.found: list[list[tuple]] = [[] for _ in range(count)]
        # Pairs that were bounded or scored, for tests of how much is pruned.
        self.bounded = self.scored = 0

    def _take(self, item: int, scores: np.ndarray, ids: list, ties: list) -> None:
        rows = self.found[item] + [(-int(s), i is None, i, t) for s, i, t in zip(scores, ids, ties)]
        rows.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0, r[3]))
        self.found[item] = rows[: self.top]
        if len(rows) >= self.top:
            self.floors[item] = max(self.floors[item], -rows[self.top - 1][0])

    def block(self, nodes: list[ItemNode], block: Block, ids: list, ties: list) -> None:
        for node in nodes:
            self.bounded += 1
            bound = block.bound(node)
            if bound > 0 and bound * SLACK >= self.floors[node.items].min():
                self._open(node, block, ids, ties)

    def _open(self, node: ItemNode, block: Block, ids: list, ties: list) -> None:
        dense = block.table(node.terms)
        rows = max(DOC_FAN[0], CELLS // max(1, len(node.terms)) // DOC_FAN[0] * DOC_FAN[0])
        for begin in range(0, len(dense), rows):
            part = dense[begin : begin + rows]
            leaves = part.reshape(-1, DOC_FAN[0], part.shape[1]).max(axis=1)
            above = np.maximum.reduceat(leaves, np.arange(0, len(leaves), DOC_FAN[1]))
            levels = [above, leaves, part]
            self._descend(node, np.arange(node.terms.size), levels, 0, np.arange(len(above)), begin, ids, ties)

    def _descend(self, node, columns, levels, level, rows, begin, ids, ties) -> None:
        """Bound the node's children against some document nodes of a level and go on with pairs that are left."""
        here = levels[level][np.ix_(rows, columns)]
        bounds = here @ node.values.T.astype(float)
        self.bounded += bounds.size
        for i, child in enumerate(node.children):
            keep = bounds[:, i] * SLACK >= max(1.0, self.floors[child.items].min())
            if not keep.any():
                continue
            fan = DOC_FAN[1 - level]
            below = (rows[keep][:, None] * fan + np.arange(fan)).ravel()
            below = below[below < len(levels[level + 1])]
            inner = columns[np.searchsorted(node.terms, child.terms)]
            if child.children:
                self._descend(child, inner, levels, level + 1, below, begin, ids, ties)
            else:
                self._score(child, levels[2][np.ix_(below, inner)], below + begin, ids, ties)

    def _score(self, leaf: ItemNode, values: np.ndarray, docs: np.ndarray, ids: list, ties: list) -> None:
        item = int(leaf.items[0])
        scores = values.astype(np.int64) @ leaf.values[0]
        self.scored += len(scores)
        good = np.flatnonzero((scores > 0) & (scores >= self.floors[item]) & (docs < len(ids)))
        if len(good):
            self._take(item, scores[good], [ids[d] for d in docs[good]], [ties[d] for d in docs[good]])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, term, times)``; ``item`` numbers the distinct rows. Stored."""
    distinct = items.select(F.col(id_col).alias("item_id"), text_of(F.col(text_col)).alias("text")).distinct()
    kind = distinct.schema["item_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for key, item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for term in terms_of(text):
                    for column, value in zip(columns, (key, item_id, term.decode(), 1)):
                        column.append(value)
            types = [pa.int64(), batch.column(1).type, pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["item", "item_id", "term", "times"]
    numbered = distinct.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    said = numbered.mapInArrow(count, f"item long, item_id {kind}, term string, times long")
    return stored(said.groupBy("item", "item_id", "term").agg(F.sum("times").alias("times")))


def document_words(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, tie, n, terms array<int>, counts array<int>)``: a text's length in words and its counts of the given ones. Stored."""
    known = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def count(batches):
        numbers = known.value
        for batch in batches:
            sizes, ends, words, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                said = terms_of(text)
                tally: dict[bytes, int] = {}
                for word in said:
                    if word in numbers:
                        tally[word] = tally.get(word, 0) + 1
                sizes.append(len(said))
                words.extend([numbers[w] for w in tally])
                counts.extend(tally.values())
                ends.append(len(words))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (words, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names)

    names = ["doc_id", "n", "terms", "counts"]
    counted = source.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, counts array<int>")
    return stored(counted.withColumn("tie", F.monotonically_increasing_id()))


def _search(vectors: DataFrame, items: list[dict[int, int]], floors: dict[int, int], n: int, words: int, top: int) -> DataFrame:
    """``(item, doc_id, tie, score)``: each task's best documents of every item that reach the item's floor."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, floors))
    kind = vectors.schema["doc_id"].dataType.simpleString()
    source = vectors.select("doc_id", "tie", "n", "terms", "counts")

    def search(batches):
        plain, least = shared.value
        nodes = item_tree(plain)
        start = np.zeros(len(plain), np.int64)
        for i, score in least.items():
            start[i] = score
        state = Search(len(plain), start, top)
        doc_type = None
        for whole in batches:
            doc_type = whole.column(0).type
            for at in range(0, len(whole), TASK_DOCS):
                _blocks(whole.slice(at, TASK_DOCS), nodes, state, n, words)
        if doc_type is None:
            return
        rows = [(i, r[2], r[3], -r[0]) for i, found in enumerate(state.found) for r in found]
        types = [pa.int32(), doc_type, pa.int64(), pa.int64()]
        columns = list(map(list, zip(*rows))) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["number", "doc_id", "tie", "score"]
        )

    return source.mapInArrow(search, f"number int, doc_id {kind}, tie long, score long")


def _blocks(batch: pa.RecordBatch, nodes: list[ItemNode], state: Search, n: int, words: int) -> None:
    """Search a batch of documents in blocks, those with the largest sums of values first, so that floors rise early."""
    sizes = batch.column(2).to_numpy(zero_copy_only=False)
    lists, counts = batch.column(3), batch.column(4)
    lengths = np.diff(lists.offsets.to_numpy())
    terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(batch)), lengths)
    # m = 100 - 25 + (25 n N) div L, in Python's integers where 64 bits could overflow.
    wide = int(sizes.max(initial=0)) * n * 25 >= 1 << 63
    m = 75 + (np.array([25 * int(s) * n // words for s in sizes]) if wide else 25 * sizes * n // max(words, 1))
    values = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    order = np.argsort(-np.bincount(doc, values, len(batch)), kind="stable")
    place = np.empty(len(batch), np.int64)
    place[order] = np.arange(len(batch))
    ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    width = int(np.prod(DOC_FAN))
    at = place[doc]
    by_block = np.argsort(at // width, kind="stable")
    cuts = np.searchsorted((at // width)[by_block], np.arange(-(-len(batch) // width) + 1))
    for b in range(len(cuts) - 1):
        part = by_block[cuts[b] : cuts[b + 1]]
        inside = order[b * width : (b + 1) * width]
        block = Block(at[part] - b * width, terms[part], values[part], len(inside))
        state.block(nodes, block, [ids[i] for i in inside], [ties[i] for i in inside])


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    batch_terms: int = BATCH_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0, best first.

    All items whose words fit into ``batch_terms`` are searched in one pass over the documents; more items take more
    passes, so what is broadcast stays bounded by that number.

    * Null or empty text, or one without words: such an item has no rows, such a document is in no list.
    * Very long texts: whole. A word of an item counts as often as the item has it.
    * Ties: the smaller document id, null ids last. Repeated documents are documents of their own and take ranks of their own.
    * Repeated items count once; rows of one item id with different texts are ranked apart from each other.
    * Empty tables: empty result. Other columns are ignored, whatever their names.
    """
    said = item_words(items, item_col, item_text_col)
    entries = said.count()
    batches = max(1, -(-entries // batch_terms))
    results = None
    for number in range(batches):
        rows = said.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == number).collect()
        if rows or number == batches - 1 and results is None:
            found = _ranked(docs, rows, top, id_col, text_col, said)
            results = found if results is None else results.unionByName(found)
    return results


def _ranked(docs: DataFrame, rows: list, top: int, id_col: str, text_col: str, said: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    vectors = document_words(docs, terms, id_col, text_col)
    n, words = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = {r["term"]: r["w"] for r in held.select("term", weight.cast("long").alias("w")).collect()}
    keys = sorted({(r["item"], r["item_id"]) for r in rows}, key=repr)
    at = {key: i for i, key in enumerate(keys)}
    items: list[dict[int, int]] = [{} for _ in keys]
    for r in rows:
        if weights.get(number[r["term"]], 0) > 0:
            items[at[r["item"], r["item_id"]]][number[r["term"]]] = r["times"] * weights[number[r["term"]]]
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    seeds = vectors.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SEED_SHARE)) == 0)
    sampled = best(_search(seeds, items, {}, n, words, top)).where(F.col("rank") == top)
    floors = {r["number"]: r["score"] for r in sampled.select("number", "score").collect()}
    found = best(_search(vectors, items, floors, n, words, top))
    names = spark.createDataFrame(
        [(i, key[1]) for i, key in enumerate(keys)], f"number int, item_id {said.schema['item_id'].dataType.simpleString()}"
    )
    return found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")

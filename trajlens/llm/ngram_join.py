"""N-gram Jaccard self-join by vertical partitioning.

Shingles are put into one global order (that of their 64-bit hashes) which is cut
into fragments. Fragments are processed apart from each other:

1. Every text becomes its set of shingle hashes; equal sets become one node.
2. Of each set only the head, its first third or so in the global order, is packed
   by fragment, so one shuffle brings together all heads that hold a shingle. Linked
   sets share a known part of their heads (see ``_head``); a set whose head shares
   less with all others together has no partner and is done.
3. The sets that are left are packed whole, one row per fragment. A fragment counts
   in how many sets each of its shingles occurs; shingles of one set alone cannot add
   to any overlap and end there.
4. What is left is put together per node, rarest shingle first. A node all of whose
   partners would need more shared shingles than it has is done. The others keep
   the prefix in which any partner must share a shingle.
5. Nodes that share a prefix shingle are compared: the overlap is counted fragment
   by fragment, and the partial overlaps are summed per pair.

A list of nodes that share a prefix shingle can hold thousands of near copies,
whose pairs are not all made: first each node is compared with one pivot, the member
of its lists that is most like an origin of copies, and linked nodes are merged into
components. After that only pairs of a list whose components still differ, and
which can reach the overlap from that shingle on, are compared. No link between
components can be missed: each pair of a list was compared, can't be linked, or
lies inside one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import parallelism, release_memory, releasing, stored, text_key, without
from trajlens.llm.components import connected_components
from trajlens.llm.hashing import SHINGLE, mix, shingle_sets

PERCENT = 75
# Shingles that one task packs at a time, and that one packing bucket holds on average.
PACK_SHINGLES, BUCKET_SHINGLES = 750_000, 1_500_000
PACK_SETS = 60_000
# Percent of a set that its head holds beyond the part in which any partner must share a shingle.
SPARE = 10
# A shingle that so many heads of one task hold is counted in the task and sent once.
COMMON = 16
# Fragments of the global order in which overlaps are counted apart.
FRAGMENT_BITS = 2
# Rows of one pivot's lists that are dealt to one group.
DEALT_ROWS = 200_000
_LOW = 6  # bytes of a shingle that are sent; the bucket stands for the rest

_NODE = "text_key long, node long, check long, n_shingles int"
_HEADS = "bucket int, nodes binary, which binary, shingles binary, known binary, counts binary"
_PACKED = "bucket int, nodes binary, sizes binary, which binary, shingles binary"
_SHARED = "part int, nodes binary, sizes binary, which binary, shingles binary, sets binary"
_SUSPECT = "node long, size int, alone int, fragment int, shingles array<long>"


def _node(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    one = mix(shingles ^ np.uint64(0x1B873593CC9E2D51)).sum(dtype=np.uint64)
    two = mix(shingles + np.uint64(0x85EBCA77C2B2AE63)).sum(dtype=np.uint64)
    pair = mix(np.array([one, two], np.uint64) ^ np.uint64(len(shingles)))
    return pair.view(np.int64).tolist()


def _name(shingles: np.ndarray, clashing: frozenset[int]) -> int:
    """The first digest of a set, or the second where different sets share the first."""
    node, check = _node(shingles)
    return check if node in clashing else node


def _head(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's ``n`` shingles its head holds, and how many of these it shares with others if it has a partner.

    Heads hold the share h of their sets. Of two sets with an overlap of at least the
    share t of either, let A be the one whose head ends first. At most (1 - h) |A| common
    shingles lie behind it, and those before lie in both heads: (t - 1 + h) of the larger
    set at least, and so of each.
    """
    spare = min(SPARE, percent)
    return -(-(100 - percent + spare) * n // 100), max(1, -(-spare * n // 100))


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, node, check, n_shingles)``: documents of equal shingle sets share a node."""
    source = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )

    def digest(batches):
        for batch in batches:
            found = [(*_node(s), len(s)) for s in shingle_sets(batch.column(2), size)]
            node, check, n = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int32())],
                names=["doc_id", "text_key", "node", "check", "n_shingles"],
            )

    return source.mapInArrow(releasing(digest), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {_NODE}")


def _rows(columns: list[list], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _packs(batches, size: int, clashing: frozenset[int], length):
    """A task's sets in packs ``{node: shingles}``, cut to ``length(n)`` shingles; a set that a pack repeats is left out."""
    held, total = {}, 0
    for batch in batches:
        for shingles in shingle_sets(batch.column(0), size):
            if not len(shingles):
                continue
            node = _name(shingles, clashing)
            if node in held:
                continue
            held[node] = shingles[: length(len(shingles))]
            total += len(held[node])
            if total >= PACK_SHINGLES or len(held) >= PACK_SETS:
                yield held
                held, total = {}, 0
    if held:
        yield held


def _slices(shingles: np.ndarray, which: np.ndarray, bits: int):
    """``(bucket, which, low bytes)`` of the shingles in each bucket of the order."""
    buckets = shingles >> np.uint64(64 - bits) if bits else np.zeros(len(shingles), np.uint64)
    buckets = buckets.astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(buckets, kind="stable")
    buckets, shingles, which = buckets[order], shingles[order], which[order]
    edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    low = shingles.view(np.uint8).reshape(-1, 8)[:, :_LOW]
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(buckets)]):
        yield int(buckets[a]), which[a:b], low[a:b].tobytes()


def _whole(low: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    """Shingles from their low bytes and their bucket."""
    wide = np.zeros((len(low) // _LOW, 8), np.uint8)
    wide[:, :_LOW] = low.reshape(-1, _LOW)
    shingle = wide.view(np.uint64).ravel()
    if bits:
        top = np.uint64(64 - bits)
        shingle = (shingle & ((np.uint64(1) << min(top, np.uint64(8 * _LOW))) - np.uint64(1))) | (np.uint64(bucket) << top)
    return shingle


def _pack_heads(texts: DataFrame, size: int, bits: int, percent: int, clashing: frozenset[int]) -> DataFrame:
    """The heads of all sets, by bucket. An entry beyond the last node stands for a shingle whose holders are counted already."""
    names, kinds = ["bucket", "nodes", "which", "shingles", "known", "counts"], [pa.int32()] + [pa.binary()] * 5

    def flush(held: dict):
        nodes = np.array(list(held), np.int64)
        shingles = np.concatenate(list(held.values()))
        which = np.repeat(np.arange(len(nodes), dtype=np.uint16), [len(s) for s in held.values()])
        order = np.argsort(shingles, kind="stable")
        shingles, which = shingles[order], which[order]
        starts = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
        runs = np.diff(np.append(starts, len(shingles)))
        common = np.repeat(runs >= COMMON, runs)
        known, counts = np.unique(which[common], return_counts=True)
        once = starts[runs >= COMMON]
        which[once] = len(nodes)
        common[once] = False
        rows = []
        for bucket, at, low in _slices(shingles[~common], which[~common], bits):
            present, local = np.unique(at, return_inverse=True)
            rows.append([bucket, nodes[present[present < len(nodes)]].tobytes(), local.astype(np.uint16).tobytes(), low, b"", b""])
        rows[len(held) % len(rows)][4:] = [nodes[known].tobytes(), counts.astype(np.uint32).tobytes()]
        return _rows(list(zip(*rows)), names, kinds)

    def pack(batches):
        for held in _packs(batches, size, clashing, lambda n: _head(n, percent)[0]):
            yield flush(held)

    return texts.mapInArrow(releasing(pack), _HEADS)


def _shared_in_heads(heads: DataFrame, bits: int) -> DataFrame:
    """``(node, shared)``: how many shingles of its head a node shares; more, if at all, for a set that several tasks hold."""

    def count(key, table):
        known, counts, low = _unpack(table, {"known": np.int64, "counts": np.uint32, "shingles": np.uint8})
        node, counted = [], []
        for n, w in zip(table.column("nodes").to_pylist(), table.column("which").to_pylist()):
            named, at = np.frombuffer(n, np.int64), np.frombuffer(w, np.uint16)
            node.append(np.append(named, 0)[at])
            counted.append(at == len(named))
        node, counted = np.concatenate(node), np.concatenate(counted)
        shingle = _whole(low, key[0].as_py(), bits)
        order = np.lexsort((node, counted, shingle))
        shingle, node, counted = shingle[order], node[order], counted[order]
        fresh = counted.copy()
        fresh[:1] = True
        fresh[1:] |= (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]) | counted[:-1]
        shingle, node, counted = shingle[fresh], node[fresh], counted[fresh]
        starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        runs = np.diff(np.append(starts, len(shingle)))
        shared = node[(np.repeat(runs, runs) >= 2) & ~counted]
        names, at = np.unique(np.concatenate([known, shared]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([counts, np.ones(len(shared))]), len(names)).astype(np.int64)
        return pa.table({"node": names, "shared": sums})

    found = heads.groupBy("bucket").applyInArrow(_released(count), "node long, shared long")
    return found.groupBy("node").agg(F.sum("shared").alias("shared"))


def _pack(texts: DataFrame, size: int, bits: int, clashing: frozenset[int]) -> DataFrame:
    """Whole sets, by bucket."""
    names, kinds = ["bucket", "nodes", "sizes", "which", "shingles"], [pa.int32()] + [pa.binary()] * 4

    def flush(held: dict):
        nodes = np.array(list(held), np.int64)
        sizes = np.array([len(s) for s in held.values()], np.uint32)
        which = np.repeat(np.arange(len(nodes), dtype=np.uint16), sizes)
        rows = []
        for bucket, at, low in _slices(np.concatenate(list(held.values())), which, bits):
            present, local = np.unique(at, return_inverse=True)
            rows.append((bucket, nodes[present].tobytes(), sizes[present].tobytes(), local.astype(np.uint16).tobytes(), low))
        return _rows(list(zip(*rows)), names, kinds)

    def pack(batches):
        for held in _packs(batches, size, clashing, lambda n: n):
            yield flush(held)

    return texts.mapInArrow(releasing(pack), _PACKED)


def _released(work):
    """The same function of a group, which releases memory after it."""

    def run(key, table):
        result = work(key, table)
        release_memory()
        return result

    return run


def _unpack(table: pa.Table, columns: dict[str, type]) -> list[np.ndarray]:
    return [
        np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in columns.items()
    ]


def _expand(table: pa.Table, which_kind) -> tuple[np.ndarray, np.ndarray]:
    """Node and set size of every packed shingle."""
    nodes, sizes = [], []
    for n, s, w in zip(*(table.column(c).to_pylist() for c in ("nodes", "sizes", "which"))):
        at = np.frombuffer(w, which_kind)
        nodes.append(np.frombuffer(n, np.int64)[at])
        sizes.append(np.frombuffer(s, np.uint32)[at])
    return np.concatenate(nodes), np.concatenate(sizes)


def _shared_shingles(packed: DataFrame, bits: int, parts: int) -> DataFrame:
    """The shingles that occur in two sets or more, packed by node, with the number of their sets."""
    names, kinds = ["part", "nodes", "sizes", "which", "shingles", "sets"], [pa.int32()] + [pa.binary()] * 5

    def count(key, table):
        (low,) = _unpack(table, {"shingles": np.uint8})
        node, size = _expand(table, np.uint16)
        shingle = _whole(low, key[0].as_py(), bits)
        order = np.lexsort((node, shingle))
        shingle, node, size = shingle[order], node[order], size[order]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
        shingle, node, size = shingle[fresh], node[fresh], size[fresh]
        starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        counts = np.diff(np.append(starts, len(shingle)))
        sets = np.repeat(counts, counts)
        keep = sets >= 2
        shingle, node, size, sets = shingle[keep], node[keep], size[keep], sets[keep].astype(np.uint32)
        part = (node.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        out = [[] for _ in names]
        for p in range(parts):
            rows = order[edges[p] : edges[p + 1]]
            if not len(rows):
                continue
            present, first, local = np.unique(node[rows], return_index=True, return_inverse=True)
            values = (p, present.tobytes(), size[rows][first].tobytes(), local.astype(np.uint32).tobytes(), shingle[rows].tobytes(), sets[rows].tobytes())
            for column, value in zip(out, values):
                column.append(value)
        return pa.Table.from_batches([_rows(out, names, kinds)])

    return packed.groupBy("bucket").applyInArrow(_released(count), _SHARED)


def _suspects(shared: DataFrame, percent: int) -> DataFrame:
    """The nodes that may have a partner: a row per fragment of the order, and one (fragment -1) with the prefix."""
    names = ["node", "size", "alone", "fragment", "shingles"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def choose(key, table):
        shingle, sets = _unpack(table, {"shingles": np.uint64, "sets": np.uint32})
        node, size = _expand(table, np.uint32)
        order = np.lexsort((shingle, sets, node))
        node, size, shingle = node[order], size[order], shingle[order]
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, int)
        out = [[] for _ in names]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
            n, held = int(size[a]), b - a
            needed = -(-percent * n // 100)
            if held < needed:
                continue
            pieces = [(-1, shingle[a : a + held - needed + 1])]
            own = np.sort(shingle[a:b])
            fragment = own >> np.uint64(64 - FRAGMENT_BITS)
            cuts = np.searchsorted(fragment, np.arange((1 << FRAGMENT_BITS) + 1, dtype=np.uint64))
            pieces += [(f, own[c:d]) for f, (c, d) in enumerate(zip(cuts[:-1], cuts[1:])) if d > c]
            for f, values in pieces:
                for column, value in zip(out, (int(node[a]), n, n - held, f, values.view(np.int64))):
                    column.append(value)
        return pa.Table.from_batches([_rows(out, names, kinds)])

    return shared.groupBy("part").applyInArrow(_released(choose), _SUSPECT)


def _links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose partial overlaps, counted per fragment, sum up to the wanted similarity."""
    one = fragments.select(F.col("node").alias("a"), "fragment", F.col("size").alias("size_a"), F.col("shingles").alias("x"))
    two = fragments.select(F.col("node").alias("b"), "fragment", F.col("size").alias("size_b"), F.col("shingles").alias("y"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"])
    return (
        partial.groupBy("a", "b")
        .agg(
            F.sum(F.size(F.array_intersect("x", "y"))).alias("overlap"),
            F.first("size_a").alias("size_a"),
            F.first("size_b").alias("size_b"),
        )
        .where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("size_a") + F.col("size_b") - F.col("overlap")))
        .select("a", "b")
    )


def _open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs ``(a, b)`` of nodes that share a list, differ in component and may be similar.

    A linked pair may be similar in the list of its first common shingle: there both
    sides hold, from that shingle on (``rest``), as many shingles as the overlap needs.

    Near copies meet in hundreds of lists, so lists are dealt by their pivot: those
    with the same pivot hold much the same nodes, and their pairs are made distinct
    in place. The lists of a pivot are dealt out further when they hold many rows.
    """
    lists = placed.groupBy("shingle").agg(F.min(F.struct("alone", "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("n"))
    loads = lists.groupBy("pivot").agg(F.sum("n").alias("rows"))
    shard = F.pmod(F.xxhash64("shingle"), F.floor(F.col("rows") / DEALT_ROWS) + 1)
    dealt = lists.join(loads, "pivot").select("shingle", "pivot", shard.alias("shard"))

    def pairs_of(key, table):
        shingle, node, component, size, rest = (
            table.column(c).to_numpy() for c in ("shingle", "node", "component", "size", "rest")
        )
        names, at = np.unique(node, return_inverse=True)
        order = np.lexsort((at, shingle))
        shingle, at, component, size, rest = (x[order] for x in (shingle, at, component, size, rest))
        starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        found, held = [], 0
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            for i in range(begin, end - 1):
                after = slice(i + 1, end)
                fits = (100 + percent) * np.minimum(rest[i], rest[after]) >= percent * (size[i] + size[after])
                others = at[after][fits & (component[after] != component[i])]
                found.append(at[i] * len(names) + others)
                held += len(others)
            if held > 4_000_000:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table({"a": names[codes // len(names)], "b": names[codes % len(names)]})

    rows = placed.join(dealt, "shingle").select("pivot", "shard", "shingle", "node", "component", "size", "rest")
    return rows.groupBy("pivot", "shard").applyInArrow(_released(pairs_of), "a long, b long").distinct()


def _shared_lists(rows: DataFrame) -> DataFrame:
    """The rows of lists with two nodes or more, each with its list's pivot.

    The pivot is the node with the fewest shingles of its own, as the origin of copies has.
    """
    best = F.min(F.struct("alone", "node", "size", "rest"))
    lists = rows.groupBy("shingle").agg(best.alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(lists.drop("n"), "shingle")


def _pivot_pairs(live: DataFrame, percent: int) -> DataFrame:
    """One pair ``(a, b)`` per node at most: with the best of its lists' pivots that it may be similar to."""
    met = live.where(F.col("node") != F.col("pivot.node")).where(
        F.lit(100 + percent) * F.least("rest", "pivot.rest") >= F.lit(percent) * (F.col("size") + F.col("pivot.size"))
    )
    chosen = met.groupBy("node").agg(F.min(F.struct("pivot.alone", "pivot.node"))["node"].alias("pivot"))
    return chosen.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _components(suspects: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of all linked nodes."""
    fragments = suspects.where("fragment >= 0")
    prefixes = suspects.where("fragment < 0").select("node", "size", "alone", F.posexplode("shingles").alias("at", "shingle"))
    rows = prefixes.select(
        "node",
        "size",
        (F.col("alone") / F.col("size")).alias("alone"),
        (F.col("size") - F.col("alone") - F.col("at")).alias("rest"),
        "shingle",
    )
    live = stored(_shared_lists(rows))  # all later steps read these rows alone
    compared = stored(_pivot_pairs(live, percent))
    first = stored(_links(compared, fragments, percent))
    labels = connected_components(first)
    placed = live.drop("pivot").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    unfinished = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    left = _open_pairs(stored(placed.join(unfinished.select("shingle"), "shingle")), percent)
    rest = _links(left.join(compared, ["a", "b"], "left_anti"), fragments, percent)
    return connected_components(first.unionByName(stored(rest)))


def _bucket_bits(shingles: int) -> int:
    return max(0, shingles // BUCKET_SHINGLES).bit_length()


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """One row per input row: ``(doc_id, n_shingles, component_id, text_key)``.

    The set of a text holds its distinct shingles of ``size`` words, A-Z
    lower-cased; fewer words make one shingle. Two documents are linked when
    100 * |intersection| >= percent * |union|; ``component_id`` is the smallest id
    reachable by links.

    * Null or blank text: no shingles, linked with nothing, a component of its own.
    * Null id: counts for the links of others; its component is the smallest id reachable, null if none has one.
    * Repeated rows and equal texts: one node, so all get the same component.
    * Same id, different texts: each row is linked by its own text.
    * Empty table: empty result. Other columns are ignored, whatever their names.

    Shingles are compared by hash: two of the same pair of documents are taken for
    one with a probability below 2^-45. Sets whose first 64-bit digest is that of another
    set go by their second one; the list of such digests is taken to the driver (about 70
    are expected among 5e10 sets). Very long texts: whole, one text's shingles must fit in a task.
    """
    nodes = stored(shingle_nodes(docs, id_col, text_col, size))
    digests = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    clashing = [r["node"] for r in digests.where("low < high").select("node").collect()]
    if clashing:
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(clashing), F.col("check")).otherwise(F.col("node")))
    filled = nodes.where("n_shingles > 0")
    classes = filled.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"))
    total = filled.agg(F.sum("n_shingles")).first()[0] or 0

    names = frozenset(clashing)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"))
    bits = _bucket_bits(_head(int(total), percent)[0])
    shared = _shared_in_heads(_pack_heads(texts.select("text"), size, bits, percent, names), bits)
    spare = F.lit(min(SPARE, percent))
    open_rows = stored(
        classes.join(shared, "node").where(F.lit(100) * F.col("shared") >= spare * F.col("n")).select("row.doc_id", "row.text_key", "n")
    )
    # The list is a share of all rows, so it is dealt out with the texts at every size.
    left = texts.join(
        open_rows.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(open_rows["doc_id"]) & (text_key(texts["text"]) == open_rows["text_key"]), "left_semi"
    )
    bits = _bucket_bits(int(open_rows.agg(F.sum("n")).first()[0] or 0))
    packed = _pack(left.select("text"), size, bits, names)
    suspects = stored(_suspects(_shared_shingles(packed, bits, parallelism(docs)), percent))
    labels = _components(suspects, percent)
    placed = filled.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(smallest, "component").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "text_key"
    )
    alone = nodes.where("n_shingles = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key"
    )
    return linked.unionByName(alone)


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with its columns unchanged.

    Rows without an id stay when no row of their component has one. Rows that repeat an id that stays, stay too.
    """
    members = similar_documents(docs, id_col, text_col, percent)
    return without(docs, members.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col, text_col)

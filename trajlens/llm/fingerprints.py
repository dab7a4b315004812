"""Document fingerprints by MinHash.

A text becomes the set of its word shingles. Each of the universal hash functions
``(a * x + b) mod 2^64 >> 32`` (a odd) gives the smallest value over the set; 16
bits of each minimum make the signature. Shingles are hashed and minimised in
numpy. Near-duplicates come from bands of the signature that are joined in Spark, all
pairs of a band that earlier links don't already join, and their Jaccard similarity is verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import parallelism, stored
from trajlens.llm.components import connected_components
from trajlens.llm.hashing import mix, shingle_sets

PERMUTATIONS, SIMILARITY = 128, 0.75
BANDS, BAND_ROWS = 32, 4
# Shingles that are permuted at a time.
CHUNK = 512
# Nodes of a band that are dealt to one block.
BLOCK = 1_000


class MinHash:
    def __init__(self, permutations: int = PERMUTATIONS, seed: int = 1):
        numbers = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.a = (numbers[:permutations] | np.uint64(1))[:, None]
        self.b = numbers[permutations:][:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray | None:
        """The signature (16-bit) of a set, None for the empty set."""
        if not len(shingles):
            return None
        least = None
        for at in range(0, len(shingles), CHUNK):
            found = (self.a * shingles[at : at + CHUNK] + self.b).min(axis=1)
            least = found if least is None else np.minimum(least, found)
        return (least >> np.uint64(32)).astype(np.uint16)


def likeness(one: np.ndarray | None, two: np.ndarray | None) -> float:
    """The share of equal minima; two empty sets are alike, an empty and a filled one are not."""
    if one is None or two is None:
        return float(one is two)
    return float((one == two).mean())


def as_text(signature: np.ndarray | None) -> str:
    return "" if signature is None else signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """``(doc_id, signature binary)`` per row, null for a text without words; equal texts have equal signatures.

    Null text: without words. Null id and repeated rows: passed on. Empty table: empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches):
        minhash = MinHash(permutations)
        for batch in batches:
            signed = [minhash(s) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if s is None else s.tobytes() for s in signed], pa.binary())],
                names=["doc_id", "signature"],
            )

    return source.mapInArrow(sign, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, signature binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``(doc_id, class_id)`` per row with an id: near-duplicates share the smallest id of their class.

    Equal texts become one node, that of their smallest id. The holders of a band of
    equal minima are first compared with the band's smallest id, and linked nodes
    are merged into components. Then all other pairs of a band whose components
    still differ are compared, so each pair that shares a band was compared or lies in
    one class. The Jaccard similarity of each pair is verified on whole texts. A band
    of nodes that are not linked gives pairs in the square of its length.

    Null or blank text: a class of its own. Null id: no row. Repeated ids: one row.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.where("id IS NOT NULL").select(F.struct("id", F.sha2("text", 256).alias("digest")).alias("key"), "text")
    signed = stored(fingerprints(keyed, "key", "text").select(F.col("doc_id.id").alias("doc_id"), "doc_id.digest", "signature"))
    filled = signed.where("signature IS NOT NULL")
    nodes = filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    copies = filled.join(nodes.select("digest", "node"), "digest").where("doc_id > node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    width = BAND_ROWS * 2
    band = F.posexplode(
        F.array(*[F.xxhash64(F.substring("signature", i * width + 1, width)) for i in range(BANDS)])
    ).alias("band", "value")
    bands = nodes.select("node", band).distinct()
    first = bands.groupBy("band", "value").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = stored(bands.join(first, ["band", "value"]))
    compared = stored(held.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(_verified(compared, texts, similarity).unionByName(copies))
    labels = connected_components(links).withColumnRenamed("component", "part")
    placed = stored(held.join(labels, "node", "left").withColumn("part", F.coalesce("part", "node")))
    left = stored(_open_pairs(placed).join(compared, ["a", "b"], "left_anti"))
    labels = connected_components(links.unionByName(_verified(left, texts, similarity))).withColumnRenamed("node", "doc_id")
    return (
        signed.select("doc_id")
        .distinct()
        .join(labels, "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    )


def _open_pairs(placed: DataFrame) -> DataFrame:
    """The distinct pairs ``(a, b)`` of nodes that share a band and differ in their part.

    The nodes of a long band are dealt into blocks, and each pair of blocks is a join
    key of its own, so no key holds many more than two blocks.
    """
    mixed = placed.groupBy("band", "value").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    blocks = F.floor(F.col("n") / BLOCK) + 1
    rows = (
        placed.join(mixed.select("band", "value"), ["band", "value"])
        .select("band", "value", "node", "part", F.pmod(F.xxhash64("node"), blocks).alias("block"), blocks.alias("blocks"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("band", "value", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "part", "block")
    )
    keys = ["band", "value", "p", "q"]
    one = rows.select(*keys, F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("block").alias("block_a"))
    two = rows.select(*keys, F.col("node").alias("b"), F.col("part").alias("part_b"), F.col("block").alias("block_b"))
    # Nodes of one block meet in that block's own key alone.
    met = one.join(two, keys).where("a < b AND part_a <> part_b AND (p = q OR block_a <> block_b)")
    return met.select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose texts have at least the wanted Jaccard similarity."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b"
    )

    def verify(batches):
        for batch in batches:
            alike = []
            for one, two in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                common = len(np.intersect1d(one, two, assume_unique=True))
                alike.append(common >= similarity * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "x", "y").mapInArrow(verify, f"a {kind}, b {kind}")


def _borders(ids: DataFrame, pieces: int) -> list[int]:
    """At most ``pieces`` - 1 ids that cut the table into ranges of about equal size."""
    shares = [i / pieces for i in range(1, pieces)]
    found = ids.agg(F.percentile_approx("doc_id", shares or [0.5], 10_000)).first()[0] or []
    return sorted(set(found)) if shares else []


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of an edited form of it, and of the text after it by descending id.

    The edited form has its last floor(n / 2) code points replaced by as many of
    the first code points of the next text (or all it has); the text with the smallest
    id is followed by the one with the largest. Returns ``(doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    * Null text: the empty text. Null ids come last. Rows that share an id follow each other by digest of the text.
    * A single row is followed by itself. Empty table: empty result. Other columns are ignored.

    Each text moves once, compressed, to the range of ids it belongs to; the first
    text of a range goes to the range before it as well.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    ranges = 4 * parallelism(docs)
    borders = _borders(source, ranges)
    # Range 0 holds the largest ids; null ids are in the last one.
    cuts = F.array(*[F.lit(b) for b in borders]).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), F.lit(len(borders))).otherwise(
        F.size(F.filter(cuts, lambda b: b >= F.col("doc_id")))
    )
    tie = F.xxhash64("text")
    heads = (
        source.select(place.alias("range"), F.struct(F.col("doc_id").isNotNull(), "doc_id", tie.alias("tie")).alias("key"))
        .groupBy("range")
        .agg(F.max("key").alias("key"))
        .orderBy("range")
        .collect()
    )
    # Where the first text of each range goes a second time: behind the range before it, the very first behind the last.
    guests: dict[tuple, int] = {}
    for i, head in enumerate(heads):
        guests[head["key"]["doc_id"], head["key"]["tie"]] = heads[i - 1]["range"]
    placed = source.select("doc_id", tie.alias("tie"), place.cast("int").alias("range"), "text")

    def send(batches):
        minhash, packer, seen = MinHash(), zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            out = [[] for _ in range(6)]
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for (doc_id, tie, at, text), shingles in zip(zip(*columns), shingle_sets(batch.column(3))):
                signature = minhash(shingles)
                row = (doc_id, tie, packer.compress(text.encode("utf-8", "surrogatepass")), None if signature is None else signature.tobytes())
                targets = [(at, False)]
                if (doc_id, tie) in guests:
                    targets.append((guests[doc_id, tie], True))
                for target, guest in targets:
                    for column, value in zip(out, (target, guest, *row)):
                        column.append(value)
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["range", "guest", "doc_id", "tie", "packed", "signature"]
            )

    def edit(batches):
        minhash, unpacker = MinHash(), zstandard.ZstdDecompressor()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the row whose next one has not come yet
        for batch in batches:
            out, edited = [[] for _ in names], []
            for at, guest, doc_id, packed, signature in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "packed", "signature"))):
                text = unpacker.decompress(packed).decode("utf-8", "surrogatepass")
                own = None if signature is None else np.frombuffer(signature, np.uint16)
                if held is not None and held[0] == at:
                    _, before_id, before, before_own = held
                    half = len(before) // 2
                    edited.append(before[: len(before) - half] + text[:half])
                    values = (before_id, len(before), "", before_own, None, 0.0, likeness(before_own, own))
                    for column, value in zip(out, values):
                        column.append(value)
                held = None if guest else (at, doc_id, text, own)
            if not edited:
                continue
            signed = [minhash(s) for s in shingle_sets(pa.array(edited, pa.large_string()))]
            out[2] = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
            out[5] = [likeness(a, b) for a, b in zip(out[3], signed)]
            out[3], out[4] = [as_text(s) for s in out[3]], [as_text(s) for s in signed]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    moved = placed.mapInArrow(send, "range int, guest boolean, doc_id long, tie long, packed binary, signature binary")
    return (
        moved.repartition("range")
        .sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
        .mapInArrow(
            edit,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
            " near_edited double, near_next double",
        )
    )

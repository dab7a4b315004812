"""Line deduplication by range-partitioned hashes, in DataFrame operations only.

1. Texts are read once: every line's key (stripped, A-Z lower-cased) becomes a
   128-bit hash, and a document's hashes are stored as one row.
2. Hashes are range-partitioned and sorted by hash, document and position. One pass
   over each sorted range streams the first occurrence of a hash; every later line
   whose document is not the first one's goes.
3. Lines that go are gathered per document as a compressed bitmap: 64-bit words of
   dropped positions, without the words in which every line stays. No text moves.
4. Where the kept text is wanted, bitmaps are joined back to the documents.

A line that a large share of all documents hold would be one huge range. Lines are
counted per slice of the hash space first, with map-side partial sums; inside slices
that hold far more than their share, the hashes are counted exactly, and for the few
that alone exceed an average slice the smallest document is known from that count.
Their lines are decided where they are and are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import UPPER, LOWER, free_name, parallelism, stored, text_of

MIN_CHARS = 10
BLANKS = " \t\n\x0b\f\r"
# Hash slices per shuffle partition, lines per slice at a large size, and the most slices there are.
SLICES_PER_PARTITION, SLICE_LINES, MOST_SLICES = 16, 1_000_000, 1 << 20
# A hash with fewer lines is never worth a count of its own.
COMMON_LINES = 1_000
WORD_BITS = 64


def _hashes(value: Column, salt: int = 1) -> tuple[Column, Column]:
    """128 bits, as two independent 64-bit hashes."""
    return F.xxhash64(value), F.xxhash64(F.lit(salt), value)


def line_keys(text: Column) -> Column:
    """The key of every line of a text, in order."""
    lines = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(BLANKS)))


def _listed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One stored row per input row: ``(row, doc, t1, t2, n_lines, hashes array<struct<hi, lo>>)``; short lines have null."""
    text = text_of(docs[text_col])

    def hashed(key: Column) -> Column:
        hi, lo = _hashes(key)
        return F.when(F.char_length(key) >= min_chars, F.struct(hi.alias("hi"), lo.alias("lo")))

    first, second = _hashes(text)
    listed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("doc"),
        first.alias("t1"),
        second.alias("t2"),
        F.transform(line_keys(text), hashed).alias("hashes"),
    )
    return stored(listed.withColumn("n_lines", F.size("hashes").cast("long")))


def _slice(slices: int) -> Column:
    return F.pmod(F.col("hi"), F.lit(slices))


def common_hashes(lines: DataFrame, slices: int) -> DataFrame:
    """``(hi, lo, first)`` of each hash with more lines than two average slices; ``first`` is its smallest document.

    Fewer than ``slices / 2`` rows. Only slices above that size are counted by hash, and both counts are summed per task first.
    """
    sizes = stored(lines.groupBy(_slice(slices).alias("slice")).agg(F.count(F.lit(1)).alias("n")))
    most = max((sizes.agg(F.sum("n")).first()[0] or 0) * 2 / slices, COMMON_LINES)
    full = sizes.where(F.col("n") > F.lit(most)).select("slice")
    within = lines.withColumn("slice", _slice(slices)).join(F.broadcast(full), "slice", "left_semi")
    counted = within.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    return stored(counted.where(F.col("n") > F.lit(most)).select("hi", "lo", "first"))


def dropped_lines(listed: DataFrame) -> DataFrame:
    """``(row, at)`` of each line whose key was seen in a smaller document."""
    lines = listed.select("row", "doc", F.posexplode("hashes").alias("at", "hash")).where("hash IS NOT NULL")
    lines = lines.select("row", "doc", "at", "hash.hi", "hash.lo")
    total = listed.agg(F.sum("n_lines")).first()[0] or 0
    partitions = parallelism(listed)
    wanted = max(partitions * SLICES_PER_PARTITION, total // SLICE_LINES)
    slices = min(1 << max(wanted - 1, 1).bit_length(), MOST_SLICES)
    common = common_hashes(lines, slices)
    known = F.broadcast(common.withColumnsRenamed({"hi": "c_hi", "lo": "c_lo"}))
    same = (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo"))
    decided = lines.join(known, same).where(~F.col("doc").eqNullSafe(F.col("first"))).select("row", "at")
    # Null ids come last and count as one document.
    in_order = Window.partitionBy("hi", "lo").orderBy(F.col("doc").asc_nulls_last(), "at")
    streamed = (
        lines.join(known, same, "left_anti")
        .repartitionByRange(partitions, "hi", "lo")
        .withColumn("first", F.first("doc").over(in_order))
        .where(~F.col("doc").eqNullSafe(F.col("first")))
        .select("row", "at")
    )
    return decided.unionByName(streamed)


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """``(doc, t1, t2, n_dropped, dropped array<struct<word, bits>>)`` of each distinct document that loses lines.

    ``t1`` and ``t2`` are hashes of the text. Bit ``b`` of word ``w`` stands for line ``64 w + b``; words in which all
    lines stay are left out. See ``drop_repeated_lines`` for the rules.
    """
    listed = _listed(docs, id_col, text_col, min_chars)
    word = F.floor(F.col("at") / WORD_BITS).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, at % {WORD_BITS})")
    words = dropped_lines(listed).groupBy("row", word).agg(F.bit_or(bit).alias("bits"))
    maps = words.groupBy("row").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
    )
    named = listed.select("row", "doc", "t1", "t2").join(maps, "row")
    # Repeated rows have equal bitmaps.
    return named.groupBy("doc", "t1", "t2").agg(
        F.first("n_dropped").alias("n_dropped"), F.first("dropped").alias("dropped")
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Every row with ``text_col`` replaced by its kept lines, and ``n_lines`` and ``n_dropped`` added (names are freed if taken).

    Lines end at ``\\n``. Two lines are equal when their keys are: blanks stripped at both ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points that two documents hold stay only in the document with the smallest id.

    * Null or empty text: one empty line, which stays. Very long texts: any number of lines; one line is one value.
    * Repeats inside the document that keeps a line: all stay.
    * Rows of one id are one document: they keep each other's lines. Repeated rows are all returned.
    * Null ids: together one document that comes after all others.
    * Empty table: empty result. Other columns are passed on unchanged, whatever their names.
    """
    maps = line_bitmaps(docs, id_col, text_col, min_chars)
    total, gone = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    text = text_of(docs[text_col])
    first, second = _hashes(text)
    key = docs[id_col].eqNullSafe(maps["doc"]) & (first == maps["t1"]) & (second == maps["t2"])
    lines = F.split(text, "\n", -1)
    # One word per 64 lines, so that a line finds its bit by position.
    table = F.map_from_entries(maps["dropped"])
    last = F.element_at(maps["dropped"], -1)["word"]
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0).cast("long")))
    whole, words = free_name(docs, "_lines"), free_name(docs, "_words")
    joined = docs.join(maps, key, "left").select(
        *[docs[c] for c in docs.columns if c != text_col],
        lines.alias(whole),
        dense.alias(words),
        F.coalesce(maps["n_dropped"], F.lit(0).cast("long")).alias(gone),
    )

    def stays(line: Column, at: Column) -> Column:
        bits = F.coalesce(F.get(F.col(words), F.floor(at / WORD_BITS).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, at % WORD_BITS) == 0

    kept = F.when(F.col(words).isNull(), F.col(whole)).otherwise(F.filter(whole, stays))
    columns = [F.concat_ws("\n", kept).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.size(whole).cast("long").alias(total), F.col(gone))

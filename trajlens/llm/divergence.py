"""How far the sources of a language differ in their words: an audit with exact integers.

Every task sorts word-start pointers over slices of its Arrow text buffers; the runs
of equal words give, per word and (language, source), occurrences and documents.
These counts are summed by (language, word) in one shuffle, and words in too few
documents of their language end there. Shares are whole parts of 10^9, smoothed.

The divergence of two sources sums over all kept words of the language, but a word
that neither uses contributes a constant. So only a source's own words are visited:
words of a language are dealt to groups of bounded size by hash, sources to blocks,
and a group adds up, for its pairs of sources, what its words change against the
constant. Nothing is made per pair of sources and word that one of them doesn't use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import stored, text_of
from trajlens.llm.hashing import text_bytes
from trajlens.llm.word_runs import SLICE_BYTES, group_runs, slices_of

MIN_DOCS, TOP_TERMS = 10, 10
WHOLE = 1_000_000_000
# Rows of one group of words, sources of one block, and numbers compared at a time inside a group.
GROUP_ROWS, BLOCK_SOURCES, CELLS = 20_000, 200, 1 << 20
_OUT_ROWS = 100_000


def _text(name: str) -> Column:
    return text_of(F.col(name))


def term_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``(lang, source, term, n, docs)``, several rows per key: occurrences and holding rows in one slice of texts.

    A row with a null term names a group, so that groups without words are known too.
    """
    source = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), _text(text_col).alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches):
        seen: set[tuple[str, str]] = set()
        for whole in batches:
            for begin, stop in slices_of(whole, 2, slice_bytes):
                batch = whole.slice(begin, stop - begin)
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                groups = {key: i for i, key in enumerate(dict.fromkeys(keys))}
                langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
                new = [key for key in groups if key not in seen]
                seen.update(new)
                if new:
                    columns = [*map(list, zip(*new)), [None] * len(new), [0] * len(new), [0] * len(new)]
                    types = [pa.string()] * 3 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                numbers = np.array([groups[k] for k in keys], np.int32)
                numbers = numbers.astype(np.uint16) if len(groups) < 1 << 16 else numbers
                terms, group, n, held = group_runs(*text_bytes(batch.column(2)), numbers)
                for at in range(0, len(terms), _OUT_ROWS):
                    code = pa.array(group[at : at + _OUT_ROWS].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            langs.take(code),
                            sources.take(code),
                            terms.slice(at, _OUT_ROWS),
                            pa.array(n[at : at + _OUT_ROWS].astype(np.int64)),
                            pa.array(held[at : at + _OUT_ROWS]),
                        ],
                        names,
                    )

    return source.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)`` of words in enough rows of their language, and one row per group with a null term.

    ``lang_n`` is the word's count in the language; ``first`` marks one row of each word. Stored; one shuffle by (lang, term).
    """
    summed = (
        counts.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    word = Window.partitionBy("lang", "term")
    weighed = summed.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(word).alias("lang_n"),
        F.sum("docs").over(word).alias("lang_docs"),
        F.row_number().over(word.orderBy("source")).alias("place"),
    )
    kept = weighed.where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs))
    return stored(kept.select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).alias("first")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + 10^9 (count + 2) div (total + 2 terms), exactly; null without terms."""
    parts = F.lit(WHOLE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = F.nullif((total + 2 * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return _div(parts, whole) + 1


def _apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def group_facts(kept: DataFrame) -> DataFrame:
    """``(lang, source, total, lang_total, lang_rows, terms, unused)``, one row per group.

    ``unused`` is the share of a word that the group doesn't use, ``lang_rows`` the number of (source, word) rows of the language.
    """
    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"),
        F.count("term").alias("rows"),
        F.count_if(F.col("first") & F.col("term").isNotNull()).alias("own_first"),
    )
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("rows").alias("lang_rows"), F.sum("own_first").alias("terms")
    )
    facts = groups.drop("own_first", "rows").join(langs, "lang")
    return stored(facts.withColumn("unused", _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))


def top_terms(shares: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: the words that a group uses more than its language, furthest apart first."""
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    used = shares.withColumn("q", q).where("n > 0 AND share > q")
    scored = used.select("lang", "source", F.col("term").alias("item"), _apart(F.col("share"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _changes(table: pa.Table) -> pa.Table:
    """What the words of one group add to the constants of its pairs of sources.

    Rows with a null share list the sources. A pair (a, b) with a < b belongs to this group if its blocks are ``low`` and ``high``.
    """
    rows = table.to_pydict()
    members = [i for i, p in enumerate(rows["share"]) if p is None]
    names = [rows["source"][i] for i in members]
    number = {name: i for i, name in enumerate(names)}
    unused = np.array([rows["unused"][i] for i in members], np.int64)
    block = np.array([rows["block"][i] for i in members])
    used = [i for i, p in enumerate(rows["share"]) if p is not None]
    terms: dict[str, int] = {}
    columns = np.array([terms.setdefault(rows["term"][i], len(terms)) for i in used], np.int64)
    holders = np.array([number[rows["source"][i]] for i in used], np.int64)
    shares = np.array([rows["share"][i] for i in used], np.int64)
    order = np.argsort(columns, kind="stable")
    columns, holders, shares = columns[order], holders[order], shares[order]

    def apart(p, q):
        return (p - q) * (p - q) // (p + q)

    constant = apart(unused[:, None], unused[None, :])
    # alone[a, b]: over a's words; both[a, b]: over words that both use.
    alone, both = np.zeros_like(constant), np.zeros_like(constant)
    width = max(1, CELLS // max(1, len(names)))
    for begin in range(0, len(terms), width):
        lo, hi = np.searchsorted(columns, [begin, begin + width])
        known = np.zeros((len(names), min(width, len(terms) - begin)), np.int64)
        known[holders[lo:hi], columns[lo:hi] - begin] = shares[lo:hi]
        filled = np.where(known > 0, known, unused[:, None])
        for a in range(len(names)):
            own = np.flatnonzero(known[a])
            if len(own):
                change = apart(known[a, own][None, :], filled[:, own]) - constant[a][:, None]
                alone[a] += change.sum(axis=1)
                both[a] += np.where(known[:, own] > 0, change, 0).sum(axis=1)
    total = alone + alone.T - both
    low, high = rows["low"][0], rows["high"][0]
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    here = (np.minimum.outer(block, block) == low) & (np.maximum.outer(block, block) == high)
    first, second = np.nonzero(here & (rank[:, None] < rank[None, :]) & ((total != 0) | (rows["shard"][0] == 0)))
    return pa.table(
        {
            "lang": pa.array([rows["lang"][0]] * len(first), pa.string()),
            "a": pa.array([names[i] for i in first], pa.string()),
            "b": pa.array([names[i] for i in second], pa.string()),
            "change": pa.array(total[first, second], pa.int64()),
        }
    )


def source_pairs(
    shares: DataFrame, facts: DataFrame, group_rows: int = GROUP_ROWS, block_sources: int = BLOCK_SOURCES
) -> DataFrame:
    """``(lang, source, item, value, rank)``: the other sources of a group's language, furthest apart first."""
    most = facts.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block_sources) or 1
    shards = F.greatest(F.ceil(F.col("lang_rows") / group_rows).cast("long"), F.lit(1).cast("long"))
    listed = ["lang", "source", "term", "share", "unused", "block", "shard"]
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block")
    words = shares.where("term IS NOT NULL AND n > 0").select(
        "lang", "source", "term", "share", "unused", block, F.pmod(F.xxhash64("term"), shards).alias("shard")
    )
    members = facts.select(
        "lang",
        "source",
        F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("long").alias("share"),
        F.coalesce("unused", F.lit(1).cast("long")).alias("unused"),
        block,
        F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    dealt = words.unionByName(members).select(*listed, other)
    dealt = dealt.select(*listed, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    changes = (
        dealt.groupBy("lang", "shard", "low", "high")
        .applyInArrow(_changes, "lang string, a string, b string, change long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("change").alias("change"))
    )
    for side in ("a", "b"):
        known = facts.select("lang", F.col("source").alias(side), F.col("unused").alias(f"{side}_unused"), "terms")
        changes = changes.join(known if side == "a" else known.drop("terms"), ["lang", side])
    constant = F.col("terms") * _apart(F.col("a_unused"), F.col("b_unused"))
    value = F.when(F.col("terms") > 0, F.col("change") + constant).otherwise(F.lit(0)).cast("long")
    sides = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    pairs = changes.select("lang", F.inline(sides), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.withColumn("rank", F.row_number().over(order))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    most_terms: int = TOP_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every occurring (language, source).

    Part ``pair`` ranks the other sources of the language by their divergence over all kept words, part ``term`` the
    ``most_terms`` words that a source uses more often than its language. Words are runs of letters and non-ASCII
    characters, A-Z lower-cased; kept are those in at least ``min_docs`` rows of the language.

    * Null text, language or source: the empty string. Texts without words: their group still takes part in pairs.
    * Very long texts: whole; one text is sorted in one task. Repeated rows count as often as they occur.
    * Ties: by the item's bytes. Languages without kept words: pairs with value 0.
    * Empty table: empty result. Other columns are ignored, whatever their names.
    """
    kept = kept_counts(term_counts(docs, text_col, lang_col, source_col), min_docs)
    facts = group_facts(kept)
    words = kept.where("term IS NOT NULL").join(facts, ["lang", "source"])
    shares = words.withColumn("share", _share(F.col("n"), F.col("total"), F.col("terms")))
    pairs, terms = source_pairs(shares, facts), top_terms(shares, most_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns)
    )

"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of fixed size. The distinct blocks are sorted and
get integer names; equal blocks get equal names and different blocks different
ones, because ties of the 64-bit sort hash are broken by the text itself. Then
adjacent names are paired, the distinct pairs are sorted and named, and so on:
the sequence of a document halves until one name is left. Two documents have the
same identity, (number of blocks, last name), exactly when their texts are equal.

Scale: block texts cross one shuffle, combined on the map side, so a text that a
third of the rows share is sent once per task. All later levels move integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import ascii_lower, free_name, stored, text_of

BLOCK_CHARS = 2048
# Names are bucket * 2^32 + rank: sorting happens inside a bucket of the sort hash.
BUCKETS = 1 << 20


def _names(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of a table of distinct keys: sort each hash bucket, rank inside it."""
    bucket = F.pmod(F.col(order[0]), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return distinct.withColumn("name", bucket * F.lit(1 << 32) + rank)


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def name_blocks(cut: DataFrame, hashed: DataFrame, key: str) -> DataFrame:
    """``(key, names array<long>)``: the block names of each key.

    ``cut`` holds ``(key, blocks array<string>)`` and may repeat a key with the same
    blocks; ``hashed`` holds each key once with the blocks' hashes.
    """
    texts = (
        cut.select(F.explode("blocks").alias("block"))
        .groupBy(F.xxhash64("block").alias("hash"))
        .agg(F.sort_array(F.collect_set("block")).alias("texts"))
    )
    # One text per hash unless 64 bits collide; only then does a block need its text to find its name.
    ranked = texts.select(
        "hash", F.posexplode("texts").alias("tie", "block"), (F.size("texts") > 1).alias("collides")
    ).withColumn("block", F.when(F.col("collides"), F.col("block")))
    names = stored(_names(ranked, ["hash", "tie"]))
    plain = names.where(~F.col("collides")).select("hash", "name")
    collisions = names.where("collides").select("hash", "block", F.col("name").alias("tied_name"))
    rows = hashed.select(key, F.posexplode("hashes").alias("at", "hash")).join(plain, "hash", "left")
    if not collisions.isEmpty():
        tied = (
            cut.select(key, F.posexplode("blocks").alias("at", "block"))
            .withColumn("hash", F.xxhash64("block"))
            .join(collisions, ["hash", "block"])
            .select(key, "at", "tied_name")
            .distinct()
        )
        rows = rows.join(tied, [key, "at"], "left").withColumn("name", F.coalesce("name", "tied_name"))
    gathered = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("seq"))
    return hashed.join(gathered, key, "left").select(
        key, F.coalesce(F.col("seq.name"), F.array().cast("array<bigint>")).alias("names")
    )


def name_sequences(sequences: DataFrame, key: str, names: str = "names") -> DataFrame:
    """``(key, blocks, name)``: reduce each sequence to one integer by naming adjacent pairs, level by level.

    Sequences of different length may share a name; together with the length it is unique.
    """
    level = stored(sequences.select(key, F.size(names).alias("blocks"), F.col(names).alias("names")))
    while (level.agg(F.max(F.size("names"))).first()[0] or 0) > 1:
        pending, done = level.where(F.size("names") > 1), level.where(F.size("names") <= 1)
        halves = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        left = lambda i: F.get("names", i * 2).alias("left")
        right = lambda i: F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("right")
        pairs = pending.select(
            key, "blocks", F.posexplode(F.transform(halves, lambda i: F.struct(left(i), right(i)))).alias("at", "pair")
        ).select(key, "blocks", "at", "pair.left", "pair.right")
        distinct = pairs.groupBy("left", "right").agg(F.first(F.xxhash64("left", "right")).alias("hash"))
        named = _names(distinct, ["hash", "left", "right"]).select("left", "right", "name")
        shorter = (
            pairs.join(named, ["left", "right"])
            .groupBy(key, "blocks")
            .agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("seq"))
            .select(key, "blocks", F.col("seq.name").alias("names"))
        )
        level = stored(done.unionByName(shorter))
    return level.select(key, "blocks", F.coalesce(F.get("names", F.lit(0)), F.lit(0)).alias("name"))


def _entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as ``(doc_id, text, text_sha256, entry)``; rows that agree in id and text share an entry."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(F.col(text_col))).alias("text"))
        .withColumn("text_sha256", F.sha2("text", 256))
        .withColumn("entry", F.concat_ws(":", "text_sha256", F.col("doc_id").cast("string")))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``(doc_id, keep_id, group_size, kept, text_sha256, copies)``.

    Texts are equal when identical after lower-casing A-Z. The row with the
    largest id of a group stays. ``copies`` counts the rows with this id and text.

    * Null text: the empty text; all empty texts form one group.
    * Null id: the row counts in its group; it is kept only if no row of the group has an id, and keep_id is then null.
    * Repeated rows (same id, same text): all are returned and counted; if that id stays, each is marked kept.
    * Same id, different texts: independent rows.
    * Empty table: empty result. Other columns are ignored, whatever their names.
    """
    source = _entries(docs, id_col, text_col)
    cut = source.withColumn("blocks", _blocks(F.col("text"), size))
    hashes = F.transform("blocks", lambda b: F.xxhash64(b)).alias("hashes")
    listed = stored(cut.select("doc_id", "text_sha256", "entry", hashes))
    hashed = stored(listed.groupBy("entry").agg(F.count(F.lit(1)).alias("rows"), F.first("hashes").alias("hashes")))
    names = name_sequences(name_blocks(cut.select("entry", "blocks"), hashed, "entry"), "entry")
    identity = stored(names.join(hashed.select("entry", "rows"), "entry"))
    rows = listed.drop("hashes").join(identity, "entry")
    groups = rows.groupBy("blocks", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(groups, ["blocks", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.col("rows").alias("copies"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one per group of equal texts, with their columns unchanged."""
    groups = stored(exact_groups(docs, id_col, text_col))
    listed = F.concat_ws(":", F.col("text_sha256"), F.col("doc_id").cast("string"))
    entry = free_name(docs, "_entry")
    digest = F.sha2(ascii_lower(text_of(docs[text_col])), 256)
    marked = docs.withColumn(entry, F.concat_ws(":", digest, docs[id_col].cast("string")))
    gone = groups.where(~F.col("kept")).select(listed.alias(entry)).distinct()
    repeated = groups.where("kept and copies > 1").select(listed.alias(entry)).distinct()
    stay = marked.join(gone, entry, "left_anti")
    if repeated.isEmpty():
        return stay.drop(entry)
    once = stay.join(repeated, entry, "left_semi").dropDuplicates([entry])
    return stay.join(repeated, entry, "left_anti").unionByName(once).drop(entry)

"""Fingerprints of tables and settings, and what files a folder holds."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.operators.ordering import local_table
from trajlens.sources.tables import path_exists

# Digest length, largest file that is read as one row (and of mounted folders), bytes read at a time from larger ones.
DIGEST_CHARS = 20
MAX_FILE_BYTES = 1_000_000_000
MAX_MOUNTED_BYTES = 64 << 20
READ_BYTES = 8 << 20
MANIFEST_SCHEMA = (
    "run_name string, table_name string, n_rows long, content_hash string, settings string, fingerprint string, "
    "listing string"
)
# Changed files that an error names.
NAMED_FILES = 10


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``(relative_path, folder, size_bytes, suffix)`` of every file below a folder; contents are not read.

    Spark's listing leaves out empty files and names that start with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    relative = relative_path("path", folder)
    name = F.element_at(F.split(relative, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return files.select(
        relative.alias("relative_path"),
        F.regexp_extract(relative, r"^(?:(.*)/)?[^/]*$", 1).alias("folder"),
        F.col("length").alias("size_bytes"),
        suffix.alias("suffix"),
    )


def inventory_counts(files: DataFrame) -> DataFrame:
    """``(folder, suffix, n_files, total_bytes)``."""
    return files.groupBy("folder", "suffix").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("total_bytes")
    )


def relative_path(path: str, folder: str) -> Column:
    """A listed path as it is called below the folder."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/*", "/")
    return F.regexp_replace(bare, f"^{_quote(_plain(folder.rstrip('/')))}/", "")


def _plain(folder: str) -> str:
    """The path part of a folder, with one leading slash."""
    rest = folder.split(":", 1)[1] if ":" in folder.split("/", 1)[0] else folder
    return "/" + rest.lstrip("/")


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def _streamed_hashes(files: DataFrame) -> DataFrame:
    """``(path, size_bytes, sha256)`` of listed files; each task reads its files piece by piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                # Hadoop writes file:/a, Arrow file:///a.
                system, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^([a-z][a-z0-9+.-]*):/(?!/)", r"\1:///", path))
                digest = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while piece := stream.read(READ_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["path", "size_bytes", "sha256"]
            )

    return files.mapInArrow(work, "path string, size_bytes long, sha256 string")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size_bytes, sha256)`` of every file of any size, many files in parallel.

    Files up to ``MAX_FILE_BYTES``, or ``MAX_MOUNTED_BYTES`` in a mounted folder, are hashed as one row by Spark, from any
    file system it reads. Larger ones are streamed through the digest in their task, from file systems that Arrow
    knows as well, so a task holds a few MB however large the file is. A digest is sequential: its
    file is read by one task. Listed as by ``inventory``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    mounted = system.getUri().getScheme() == "file"
    limit = min(MAX_MOUNTED_BYTES, MAX_FILE_BYTES) if mounted else MAX_FILE_BYTES
    small, size = F.col("length") <= limit, F.col("length").alias("size_bytes")
    hashed = files.where(small).select("path", size, F.sha2("content", 256).alias("sha256"))
    return hashed.unionByName(_streamed_hashes(files.where(~small).select("path", size)))


def hash_sums(columns: list[str]) -> list[Column]:
    """Aggregates ``n_rows, _a, _b``: row count and two sums of independent row hashes."""
    named = [F.col(f"`{c}`") for c in sorted(columns)]

    def total(*extra):
        return F.coalesce(F.sum(F.xxhash64(*extra, *named).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))

    return [F.count(F.lit(1)).alias("n_rows"), total().alias("_a"), total(F.lit("second")).alias("_b")]


def sums_digest(n_rows: int, a: Any, b: Any) -> str:
    return hashlib.sha256(f"{n_rows}|{int(a)}|{int(b)}".encode()).hexdigest()[:DIGEST_CHARS]


def content_hash(df: DataFrame) -> DataFrame:
    """``(n_rows, content_hash)``: independent of row order and partitioning, counts duplicates.

    Two sums of independent row hashes; only two numbers per task are shuffled.
    """
    sums = df.agg(*hash_sums(df.columns))
    text = F.concat_ws("|", F.col("n_rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return sums.select("n_rows", F.substring(F.sha2(text, 256), 1, DIGEST_CHARS).alias("content_hash"))


def portable_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(n_rows, digest)`` that any engine with MD5 can repeat: the sum over all rows of the first 15 hex digits.

    A row is its columns as text, joined by a bar; a null is an empty text. For columns whose text is the same
    everywhere: integers, strings, dates.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def settings_text(settings: Mapping[str, Any]) -> str:
    """Canonical JSON: sorted keys, no spaces."""
    return json.dumps(dict(settings), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def settings_digest(settings: Mapping[str, Any]) -> str:
    return hashlib.sha256(settings_text(settings).encode("utf-8")).hexdigest()[:DIGEST_CHARS]


def _fingerprint_text(text: str, n_rows: int, content: str) -> str:
    return hashlib.sha256(f"{text}|{n_rows}|{content}".encode()).hexdigest()[:DIGEST_CHARS]


def fingerprint(
    df: DataFrame, run_name: str, table_name: str, settings: Mapping[str, Any], facts: tuple[int, str] | None = None
) -> DataFrame:
    """One manifest row: what the table holds, which settings made it, and a digest of both.

    ``facts`` are the row count and content hash where they are known, as after ``windows.store_windows``.
    """
    text = settings_text({"run_name": run_name, **settings})
    n_rows, content = facts or tuple(content_hash(df).first())
    row = (run_name, table_name, n_rows, content, text, _fingerprint_text(text, n_rows, content))
    return local_table(df.sparkSession, [row], MANIFEST_SCHEMA.rsplit(",", 1)[0])


def data_files(df: DataFrame) -> DataFrame | None:
    """``(path, size, modified)`` of the files of a table that is read as it is; None where anything is done to it.

    Only names, sizes and times are read.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "LogicalRelation":
        return None
    read = df.inputFiles()
    if not read:
        return None
    folders = sorted({path.rsplit("/", 1)[0] for path in read})
    listed = spark.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    return listed.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def _listing(files: DataFrame | None) -> str | None:
    return None if files is None else sums_digest(*files.agg(*hash_sums(files.columns)).first())


def _append_manifest(df: DataFrame, manifest: str, row: tuple, files: DataFrame | None) -> None:
    table = df.sparkSession.createDataFrame([row], MANIFEST_SCHEMA).withColumn("written_at", F.current_timestamp())
    if files is not None:
        named = files.withColumn("table_name", F.lit(row[1])).withColumn("listing", F.lit(row[-1]))
        named.coalesce(1).write.mode("append").parquet(f"{manifest.rstrip('/')}_files")
    table.coalesce(1).write.mode("append").parquet(manifest)


def write_preparation(
    df: DataFrame,
    manifest: str,
    run_name: str,
    table_name: str,
    settings: Mapping[str, Any],
    facts: tuple[int, str] | None = None,
) -> str:
    """Append the fingerprint to the manifest table; returns it.

    For a stored table, the names, sizes and times of its files are kept as well,
    so that it can be verified without being read.
    """
    row = tuple(fingerprint(df, run_name, table_name, settings, facts).first())
    files = data_files(df)
    _append_manifest(df, manifest, (*row, _listing(files)), files)
    return row[-1]


def changed_files(df: DataFrame, manifest: str, listing: str) -> DataFrame | None:
    """``(path, change)`` of the table's files that were added, removed or changed since they were listed."""
    now = data_files(df)
    path = f"{manifest.rstrip('/')}_files"
    if now is None or not path_exists(df.sparkSession, path):
        return None
    then = df.sparkSession.read.parquet(path).where(F.col("listing") == listing).drop("table_name", "listing").distinct()
    both = now.withColumnsRenamed({"size": "_s", "modified": "_m"}).join(then, "path", "full")
    change = F.when(F.col("_s").isNull(), "removed").when(F.col("size").isNull(), "added")
    change = change.when((F.col("_s") != F.col("size")) | (F.col("_m") != F.col("modified")), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def validate_preparation(
    df: DataFrame, manifest: str, run_name: str, table_name: str, settings: Mapping[str, Any]
) -> str:
    """Fail unless the newest manifest row of this table matches the table, the run and the settings.

    A stored table whose files have the names, sizes and times that were listed is taken as unchanged, and none of
    its cells are read. Otherwise its content is hashed: if that is still the same, the new list of files is kept for
    next time; if not, the error names files that changed.
    """
    spark = df.sparkSession
    if not path_exists(spark, manifest):
        raise FileNotFoundError(f"nothing was prepared yet: no manifest at {manifest}")
    newest = (
        spark.read.parquet(manifest)
        .where(F.col("table_name") == table_name)
        .orderBy(F.desc("written_at"))
        .limit(1)
        .collect()
    )
    if not newest:
        raise FileNotFoundError(f"nothing was prepared yet for table {table_name}")
    found = newest[0]
    text = settings_text({"run_name": run_name, **settings})
    files = data_files(df)
    listing = _listing(files)
    if listing is not None and listing == found["listing"]:
        expected = _fingerprint_text(text, found["n_rows"], found["content_hash"])
    else:
        expected = fingerprint(df, run_name, table_name, settings).first()["fingerprint"]
    if found["run_name"] != run_name or found["fingerprint"] != expected:
        changed = changed_files(df, manifest, found["listing"]) if found["listing"] else None
        named = [] if changed is None else changed.orderBy("path").limit(NAMED_FILES).collect()
        raise RuntimeError(
            f"table {table_name} was not prepared for this run: expected run={run_name}, fingerprint={expected}; "
            f"found run={found['run_name']}, fingerprint={found['fingerprint']}"
            + "".join(f"\n- {r['change']}: {r['path']}" for r in named)
        )
    if listing is not None and listing != found["listing"]:
        _append_manifest(df, manifest, (*[found[c] for c in found.asDict() if c not in ("listing", "written_at")], listing), files)
    return expected

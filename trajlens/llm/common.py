"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.operators.ordering import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, LOWER)


def text_of(text: Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def stored(df: DataFrame) -> DataFrame:
    """Write a table once into the cluster's shared folder and read it back, which cuts the lineage.

    The folder is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """Tells rows of one id and different texts apart."""
    return F.xxhash64(text_of(text))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are not among ``gone``, a table ``(doc_id, text_key)``; null ids match each other.

    Rows are told apart by their id itself and 64 bits of their text, so that only other
    texts of the same id could be mixed up. The list of rows to drop is stored, so that
    Spark broadcasts it only while its size allows.
    """
    named = stored(gone.select(F.col("doc_id").alias("_gone_doc"), F.col("text_key").alias("_gone_text")).distinct())
    same = docs[id_col].eqNullSafe(named["_gone_doc"]) & (text_key(docs[text_col]) == named["_gone_text"])
    return docs.join(named, same, "left_anti")


def release_memory() -> None:
    """Give freed memory of a Python worker back to the system; the worker stays idle through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches, which releases memory when its input has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return run

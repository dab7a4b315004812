"""Report and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.sources.tables import path_exists


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Union of rows of different shape; columns in first-seen order, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def write_report(reports: DataFrame | Sequence[DataFrame], path: str, fmt: str = "csv", single_file: bool = True) -> None:
    """Overwrite a report folder as CSV with header, or as Parquet."""
    df = reports if isinstance(reports, DataFrame) else union_reports(reports)
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = (), key: Sequence[str] = ()) -> None:
    """Append to a Parquet results table, such that a repeated append changes nothing.

    With ``partition_by``, the partitions that ``df`` has rows for are replaced: name the columns that tell runs
    apart, and a run that is written again takes the place of its rows. With ``key``, rows whose key the table
    already holds are left out, and of rows with one key any one is written. With neither, rows are always added.
    """
    if partition_by and key:
        raise ValueError("give either partition_by or key")
    if partition_by:
        replacing = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replacing.partitionBy(*partition_by).parquet(path)
        return
    if key:
        df = df.dropDuplicates(list(key))
        if path_exists(df.sparkSession, path):
            known = df.sparkSession.read.parquet(path).select(*[F.col(k).alias(f"_known_{k}") for k in key])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in key])
            df = df.join(known, same, "left_anti")
    df.write.mode("append").parquet(path)

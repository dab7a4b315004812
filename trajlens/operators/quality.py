"""Shape, missing values, duplicates and constant columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.expressions import is_missing, safe_numeric
from trajlens.operators.ordering import local_table, settled

# From this many columns on, one aggregate per column makes too large a plan,
# and (position, value) pairs are aggregated instead.
WIDE_COLUMNS = 50


def shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def row_hash(columns: Sequence[Column]) -> list[Column]:
    """128 bits of a row as two columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``(n_duplicates)``: rows beyond the first of each distinct (sub)row.

    Rows are counted by their hash, so 16 bytes of a row are shuffled, summed per task. Whole rows are compared only
    where a hash occurs more than once, so rows that merely share a hash do not count.
    """
    keys = [F.col(f"`{k}`") for k in (list(subset) if subset else df.columns)]
    first, second = row_hash(keys)
    hashed = df.select(*keys, first.alias("_h1"), second.alias("_h2"))
    often = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    often = settled(often.select(F.col("_h1").alias("_o1"), F.col("_h2").alias("_o2")))
    again = hashed.join(often, (F.col("_h1") == F.col("_o1")) & (F.col("_h2") == F.col("_o2")), "left_semi")
    copies = again.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def _column_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return local_table(df.sparkSession, list(enumerate(names)), "ordinal int, column string")


def _count_flags(df: DataFrame, names: Sequence[str], flags: Sequence[Column]) -> DataFrame:
    """``(ordinal, column, n_flagged, n_rows)``, one pass over the data for any number of columns."""
    catalog = _column_names(df, names)
    if len(names) < WIDE_COLUMNS:
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.array(*[F.count_if(flag) for flag in flags]).alias("_counts"),
        )
        counted = row.select("n_rows", F.posexplode("_counts").alias("ordinal", "n_flagged"))
        return catalog.join(F.broadcast(counted), "ordinal")
    # Only the flagged cells are exploded; -1 stands for the row itself.
    cells = F.array_compact(F.array(F.lit(-1), *[F.when(flag, F.lit(i)) for i, flag in enumerate(flags)]))
    counted = df.select(F.explode(cells).alias("ordinal")).groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_flagged"))
    every = Window.partitionBy(F.lit(0))  # one row per column of the table
    return (
        catalog.unionByName(local_table(df.sparkSession, [(-1, None)], catalog.schema))
        .join(F.broadcast(counted), "ordinal", "left")
        .withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))
        .withColumn("n_rows", F.max(F.when(F.col("ordinal") == -1, F.col("n_flagged"))).over(every))
        .where(F.col("ordinal") >= 0)
    )


def missing_report(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """``(column, missing_count, missing_ratio)``, highest ratio first, ties in column order."""
    types = dict(df.dtypes)
    flags = [is_missing(F.col(f"`{name}`"), types[name]) for name in df.columns]
    counted = _count_flags(df, df.columns, flags)
    report = (
        counted.select(
            "ordinal",
            "column",
            F.col("n_flagged").cast("long").alias("missing_count"),
            (F.col("n_flagged") / F.greatest(F.col("n_rows"), F.lit(1))).cast("double").alias("missing_ratio"),
        )
        .orderBy(F.desc("missing_ratio"), "ordinal")
    )
    if top_n is not None:
        report = report.limit(top_n)
    return report.drop("ordinal")


def column_profile(df: DataFrame) -> DataFrame:
    """``(ordinal, column, dtype, missing_count, missing_ratio)`` in column order."""
    dtypes = local_table(
        df.sparkSession,
        [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)],
        "ordinal int, column string, dtype string",
    )
    return dtypes.join(missing_report(df), "column").select(
        "ordinal", "column", "dtype", "missing_count", "missing_ratio"
    ).orderBy("ordinal")


def numeric_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column, from one pass and with null and NaN left out.

    ``(ordinal, column, n_rows, n_values, low, high, mean, variance)`` where the
    variance is that of the population.
    """
    columns = list(columns)
    catalog = _column_names(df, columns)

    def aggregates(value: Column) -> list[Column]:
        return [F.count(value), F.min(value), F.max(value), F.avg(value), F.var_pop(value)]

    names = ["n_values", "low", "high", "mean", "variance"]
    if len(columns) < WIDE_COLUMNS:
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.array(
                *[F.struct(*[a.alias(n) for a, n in zip(aggregates(safe_numeric(c)), names)]) for c in columns]
            ).alias("_stats"),
        )
        stats = row.select("n_rows", F.posexplode("_stats").alias("ordinal", "_s")).select("n_rows", "ordinal", "_s.*")
    else:
        cells = df.select(F.posexplode(F.array(*[safe_numeric(c) for c in columns])).alias("ordinal", "_v"))
        stats = cells.groupBy("ordinal").agg(
            F.count(F.lit(1)).alias("n_rows"), *[a.alias(n) for a, n in zip(aggregates(F.col("_v")), names)]
        )
    joined = catalog.join(F.broadcast(stats), "ordinal", "left")
    return joined.select(
        "ordinal",
        "column",
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("n_rows", "n_values")],
        *names[1:],
    ).orderBy("ordinal")


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None, nulls: str = "ignore") -> DataFrame:
    """``(column)`` of columns that hold a single value.

    ``nulls="ignore"``: numeric columns whose minimum equals their maximum with
    null and NaN left out; a column without any value is constant.
    ``nulls="value"``: any column with at most one distinct value, null included.
    """
    names = list(columns) if columns is not None else df.columns
    if nulls == "ignore":
        stats = numeric_moments(df, names)
        flat = (F.col("n_values") == 0) | (F.col("low") == F.col("high"))
        return stats.where(flat).select("column")
    if nulls != "value":
        raise ValueError(f"nulls must be 'ignore' or 'value', not {nulls!r}")
    flat = F.array(
        *[
            F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True))
            & ((F.count(f"`{c}`") == 0) | (F.count(f"`{c}`") == F.count(F.lit(1))))
            for c in names
        ]
    )
    row = df.agg(flat.alias("_flat")).select(F.posexplode("_flat").alias("ordinal", "_constant"))
    return (
        _column_names(df, names)
        .join(F.broadcast(row.where("_constant")), "ordinal")
        .orderBy("ordinal")
        .select("column")
    )

"""Time gaps and trajectory lengths."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.operators.ordering import (
    MAX_GROUP_ROWS,
    beside,
    in_chunks,
    large_group_positions,
    large_groups,
    local_table,
    once,
    rows_outside,
)
from trajlens.operators.quantiles import column_ranks, exact_percentiles

# Positions of one chunk of a large trajectory.
CHUNK_ROWS = 100_000
# Size of a stored sketch. Rank error of a sketch of size k is SKETCH_ERROR / k ** SKETCH_POWER.
SKETCH_K = 800
SKETCH_ERROR, SKETCH_POWER = 2.296, 0.9723


def gaps(
    df: DataFrame,
    entity: str,
    time: str,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(entity, time, prev_time, gap)`` for every step that has an earlier step."""
    steps = df.select(F.col(entity), F.col(time).cast("double").alias(time))
    groups = large_groups(steps, [entity], max_group_rows)

    def between(frame: DataFrame, *by: str) -> DataFrame:
        window = Window.partitionBy(entity, *by).orderBy(time)
        return frame.withColumn("prev_time", F.lag(time).over(window))

    if groups is None:
        paired = between(steps)
    else:
        placed = large_group_positions(steps, groups, [entity], [time], slice_rows=max(max_group_rows // 4, 1))
        chunks = between(in_chunks(placed, chunk_rows, before=1), "_chunk")
        paired = between(rows_outside(steps, groups, [entity])).unionByName(
            chunks.where("_own").select(entity, time, "prev_time")
        )
    paired = paired.withColumn("gap", F.col(time) - F.col("prev_time"))
    return paired.where(F.col("gap").isNotNull())


def gap_report(
    df: DataFrame,
    entity: str,
    time: str,
    sample_fraction: float | None = None,
    exact: bool = False,
    seed: int = 42,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(n_gaps, mean_gap, median_gap, p95_gap, min_gap, max_gap)``.

    Percentiles come from a bounded sketch, or are the exact order statistics.
    """
    if sample_fraction is not None and 0 < sample_fraction < 1:
        df = df.sample(withReplacement=False, fraction=sample_fraction, seed=seed)
    steps = gaps(df, entity, time, max_group_rows)
    return _summary(
        steps,
        "gap",
        {"median_gap": 0.5, "p95_gap": 0.95},
        [
            F.count("gap").alias("n_gaps"),
            F.avg("gap").alias("mean_gap"),
            F.min("gap").alias("min_gap"),
            F.max("gap").alias("max_gap"),
        ],
        exact,
        max_group_rows,
    ).select("n_gaps", "mean_gap", "median_gap", "p95_gap", "min_gap", "max_gap")


def length_per_entity(df: DataFrame, entity: str, limit: int | None = None) -> DataFrame:
    """``(entity, n_records)``; the optional cap of the report keeps the lowest ids."""
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_records"))
    return counts if limit is None else counts.orderBy(entity).limit(limit)


def length_report(
    df: DataFrame,
    entity: str,
    exact: bool = False,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """``(n_entities, mean_records, median_records, p05_records, p95_records, min_records, max_records)``.

    ``lengths`` is what ``length_per_entity`` gives, where the caller has it already.
    """
    return _summary(
        length_per_entity(df, entity) if lengths is None else lengths,
        "n_records",
        {"median_records": 0.5, "p05_records": 0.05, "p95_records": 0.95},
        [
            F.count("n_records").alias("n_entities"),
            F.avg("n_records").alias("mean_records"),
            F.min("n_records").alias("min_records"),
            F.max("n_records").alias("max_records"),
        ],
        exact,
        max_group_rows,
    ).select(
        "n_entities", "mean_records", "median_records", "p05_records", "p95_records", "min_records", "max_records"
    )


# --- reports that merge ----------------------------------------------------


def distribution_sketches(df: DataFrame, value: str, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """``(by…, n, total, low, high, sketch)`` of the non-missing values, one small row per group.

    Store it per day or source; ``merged_distribution`` puts any of the rows together without a look at the values.
    """
    number = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    values = df.select(*by, number.alias("_value")).where(F.col("_value").isNotNull())
    return values.groupBy(*by).agg(
        F.count("_value").alias("n"),
        F.sum("_value").alias("total"),
        F.min("_value").alias("low"),
        F.max("_value").alias("high"),
        F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"),
    )


def merged_distribution(
    sketches: DataFrame, fractions: Mapping[str, float], by: Sequence[str] = (), k: int = SKETCH_K
) -> DataFrame:
    """``(by…, n, mean, min, max, one column per fraction, rank_error)`` from stored sketches.

    Counts, mean and ends are exact. The rank of a percentile is off by at most ``rank_error`` times ``n`` in 99 of
    100 cases, the error that a sketch of size ``k`` has, merged or not.
    """
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("_total"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    return merged.select(
        *by,
        "n",
        (F.col("_total") / F.col("n")).alias("mean"),
        "min",
        "max",
        *[F.kll_sketch_get_quantile_double("_sketch", F.lit(float(f))).alias(name) for name, f in fractions.items()],
        F.lit(SKETCH_ERROR / k**SKETCH_POWER).alias("rank_error"),
    )


def _summary(df, value, fractions, aggregates, exact, max_group_rows) -> DataFrame:
    if not exact:
        sketch = [F.percentile_approx(value, f).cast("double").alias(name) for name, f in fractions.items()]
        return df.agg(*aggregates, *sketch)
    df = once(df.select(value))  # for the facts and the ranks
    number = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    facts = df.agg(*aggregates, F.count(number).alias("_n"))
    row = facts.first()
    found = local_table(df.sparkSession, [tuple(row)], facts.schema).drop("_n")
    if max_group_rows is None or row["_n"] <= max_group_rows:
        return beside(exact_percentiles(df, [], value, fractions, discrete=True, max_group_rows=None), found, [])
    places = {name: max(math.ceil(row["_n"] * f) - 1, 0) for name, f in fractions.items()}
    ranks = column_ranks(df, {value: (number, row["_n"], set(places.values()))})[value]
    return found.select("*", *[F.lit(ranks[place]).alias(name) for name, place in places.items()])

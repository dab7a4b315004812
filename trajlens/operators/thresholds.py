"""Decision thresholds, one per group of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.expressions import grid_point, grid_points_below
from trajlens.operators.ordering import MAX_GROUP_ROWS, beside
from trajlens.operators.quantiles import exact_percentiles

# Threshold defaults and strategy names.
PERCENTILE = 95.0
GRID_POINTS = 200
BEST_F1 = "best_f1_on_validation"
VALIDATION_PERCENTILE = "validation_percentile"


def percentile(
    scores: DataFrame,
    score: str,
    percent: float = PERCENTILE,
    by: Sequence[str] = (),
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, threshold)``: linearly interpolated percentile; fails when there is no score at all."""
    found = exact_percentiles(scores, by, score, {"threshold": percent / 100.0}, max_group_rows=max_group_rows)
    if by:
        return found
    empty = F.raise_error(F.lit("no scores to take a threshold from")).cast("double")
    return found.withColumn("threshold", F.coalesce("threshold", empty))


def best_f1(
    scores: DataFrame,
    score: str,
    label: str = "y_true",
    by: Sequence[str] = (),
    points: int = GRID_POINTS,
    fallback_percent: float = PERCENTILE,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, threshold, f1)``: the first point of an even grid with the highest F1.

    A row is above the first ``k`` grid points, and ``k`` is computed from the
    score, so rows are counted per ``k`` (at most points + 1 rows per group) and
    running totals over ``k`` give the confusion counts of every grid point. No
    row is compared with the whole grid. A group with a single class falls back
    to a percentile and has no F1.
    """
    by = list(by)
    usable = (
        scores.where((F.col(label) >= 0) & F.col(score).isNotNull())
        .select(*by, F.col(score).cast("double").alias("_s"), (F.col(label) == 1).cast("int").alias("_y"))
    )
    y = F.col("_y")
    ranges = usable.groupBy(*by).agg(
        F.min("_s").alias("_low"),
        F.max("_s").alias("_high"),
        F.sum(y).alias("_positives"),
        F.count(F.lit(1)).alias("_n"),
    )
    if not by:
        empty = F.raise_error(F.lit("no labelled scores to take a threshold from")).cast("double")
        ranges = ranges.withColumn("_low", F.when(F.col("_n") == 0, empty).otherwise(F.col("_low")))
    low, high = F.col("_low"), F.col("_high")
    both = (F.col("_positives") > 0) & (F.col("_positives") < F.col("_n"))

    ranged = beside(usable, ranges, by)
    placed = ranged.where(both)
    counted = placed.groupBy(
        *by, "_low", "_high", "_positives", grid_points_below(F.col("_s"), low, high, points).alias("_k")
    ).agg(F.sum(y).alias("_tp"), F.count(F.lit(1)).alias("_above"))
    # Grid point i is below exactly the rows with k > i; between two filled k nothing
    # changes, so the first point of each stretch is the previous filled k. The lowest
    # score always has k = 0 and stands for the grid start with nothing above it, the
    # answer when no point has a positive F1.
    from_k = Window.partitionBy(*by, "_low", "_high").orderBy(F.desc("_k"))
    stretch = Window.partitionBy(*by, "_low", "_high").orderBy("_k")
    totals = counted.select(
        *by,
        "_low",
        "_high",
        "_positives",
        F.coalesce(F.lag("_k").over(stretch), F.lit(0)).alias("_i"),
        "_k",
        F.sum("_tp").over(from_k.rowsBetween(Window.unboundedPreceding, 0)).alias("_tp"),
        F.sum("_above").over(from_k.rowsBetween(Window.unboundedPreceding, 0)).alias("_above"),
    ).where(F.col("_i") < points)
    f1 = F.when(F.col("_k") == 0, F.lit(0.0)).otherwise(
        (2.0 * F.col("_tp")) / (F.col("_positives") + F.col("_above"))
    )
    ranked = totals.select(
        *by, grid_point(F.col("_i"), low, high, points).alias("threshold"), f1.alias("f1")
    )
    best = Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold")
    chosen = ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")

    fallback = exact_percentiles(
        ranged.where(~both), by, "_s", {"threshold": fallback_percent / 100.0}, max_group_rows=max_group_rows
    ).where(F.col("threshold").isNotNull())
    return chosen.unionByName(fallback.withColumn("f1", F.lit(None).cast("double")))


def select(
    scores: DataFrame,
    score: str,
    label: str = "y_true",
    strategy: str = BEST_F1,
    percent: float = PERCENTILE,
    by: Sequence[str] = (),
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, threshold)`` by the named strategy."""
    if strategy == VALIDATION_PERCENTILE:
        return percentile(scores, score, percent, by, max_group_rows)
    if strategy == BEST_F1:
        if label not in scores.columns:
            raise ValueError(f"strategy {strategy} needs the label column {label!r}")
        return best_f1(scores, score, label, by, max_group_rows=max_group_rows).drop("f1")
    raise ValueError(f"unknown threshold strategy: {strategy}")

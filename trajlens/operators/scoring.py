"""Window scores, classification, and the roll-up to entities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlens.models.batches import window_batch
from trajlens.operators.labels import UNLABELLED
from trajlens.operators.ordering import MAX_GROUP_ROWS, beside, large_groups, once
from trajlens.operators.quantiles import exact_percentiles, percentile_of, sorted_values

SCORE = "outlier_score"
PREDICTION = "is_outlier"


def score_windows(windows: DataFrame, model, entity: str) -> DataFrame:
    """``(window_id, entity, start_time_step, end_time_step, y_true, outlier_score)``.

    The score is the mean squared difference between a window and its
    reconstruction. Windows stream through the tasks in Arrow batches; the
    matrix is dropped there and nothing is shuffled.
    """
    kept = ["window_id", entity, "start_time_step", "end_time_step", "y_true"]
    fields = [windows.schema[c] for c in kept] + [T.StructField(SCORE, T.DoubleType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = window_batch(batch)
            scores = ((x - model.reconstruct(x)) ** 2).mean(axis=(1, 2)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(scores, type=pa.float64())], names=[*kept, SCORE]
            )

    scored = windows.select(*kept, "X").mapInArrow(work, T.StructType(fields))
    return scored.withColumn("y_true", F.coalesce("y_true", F.lit(UNLABELLED)))


def classify(
    scores: DataFrame,
    threshold: float | Column | None = None,
    thresholds: DataFrame | None = None,
    by: Sequence[str] = ("model",),
    score: str = SCORE,
    prediction: str = PREDICTION,
) -> DataFrame:
    """1 when the score is strictly above the threshold.

    The threshold is one number, or a ``thresholds`` table with one row per ``by`` key.
    """
    if (threshold is None) == (thresholds is None):
        raise ValueError("give either threshold or thresholds")
    if threshold is not None:
        limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        return scores.withColumn(prediction, (F.col(score) > limit).cast("int"))
    limits = thresholds.select(*by, F.col("threshold").alias("_threshold"))
    flagged = beside(scores, limits, by).withColumn(prediction, (F.col(score) > F.col("_threshold")).cast("int"))
    return flagged.drop("_threshold")


def predictions(
    scored: DataFrame, entity: str, score: str = SCORE, label: str = "y_true", prediction: str = PREDICTION
) -> DataFrame:
    """Prediction rows with a label of -1 where none is known; no prediction column if there is none."""
    label_col = F.coalesce(F.col(label), F.lit(UNLABELLED)).cast("int") if label in scored.columns else F.lit(UNLABELLED)
    present = [c for c in ("window_id", entity, "start_time_step", "end_time_step") if c in scored.columns]
    extra = [F.col(prediction).cast("int").alias(prediction)] if prediction in scored.columns else []
    return scored.select(*present, label_col.alias(label), F.col(score).cast("double").alias(score), *extra)


def aggregate_entities(
    scored: DataFrame,
    entity: str,
    by: Sequence[str] = (),
    score: str = SCORE,
    label: str = "y_true",
    prediction: str | None = PREDICTION,
    min_windows: int = 1,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """One row per entity: max, mean, median and p95 score, window count, label, prediction summary.

    Everything but the two percentiles is combined before the shuffle. Entities
    above ``max_group_rows`` get their percentiles without a per-group buffer. Scores
    that are not stored yet are stored once.
    """
    keys = [*by, entity]
    has_prediction = prediction is not None and prediction in scored.columns
    known = F.when(F.col(label) >= 0, F.col(label)) if label in scored.columns else F.lit(None).cast("int")
    aggregates = [
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
        F.count(F.lit(1)).alias("n_windows"),
        F.coalesce(F.max(known), F.lit(UNLABELLED)).cast("int").alias(label),
    ]
    if has_prediction:
        aggregates += [
            F.coalesce(F.max(prediction), F.lit(0)).alias("any_outlier"),
            F.coalesce(F.avg(prediction), F.lit(0.0)).alias("outlier_window_ratio"),
        ]
    fractions = {"median_score": 0.5, "p95_score": 0.95}
    scored = once(scored.select(*keys, *[c for c in dict.fromkeys((score, label, prediction)) if c in scored.columns]))
    groups = large_groups(scored, keys, max_group_rows)
    if groups is None:
        arrays = scored.groupBy(*keys).agg(*aggregates, sorted_values(score).alias("_sorted"))
        percentiles = [percentile_of("_sorted", f).alias(name) for name, f in fractions.items()]
        rolled = arrays.select("*", *percentiles).drop("_sorted")
    else:
        ranks = exact_percentiles(scored, keys, score, fractions, max_group_rows=max_group_rows)
        rolled = scored.groupBy(*keys).agg(*aggregates).join(ranks, keys, "left")
    if prediction is not None and not has_prediction:
        # Kept for scores that were not thresholded yet: nothing is flagged.
        rolled = rolled.withColumn("any_outlier", F.lit(0)).withColumn("outlier_window_ratio", F.lit(0.0))
    flags = ["any_outlier", "outlier_window_ratio"] if prediction is not None else []
    return rolled.where(F.col("n_windows") >= min_windows).select(
        *keys, "max_score", "mean_score", "median_score", "p95_score", "n_windows", label, *flags
    )


def window_summary(
    scored: DataFrame, entity: str, by: Sequence[str] = (), score: str = SCORE,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, n_windows, n_entities, mean, median and p95 of the score)``."""
    scored = once(scored.select(*by, entity, score))
    per_entity = scored.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_sum"))
    counts = per_entity.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_windows"),
        F.count(entity).alias("n_entities"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_outlier_score"),
    )
    fractions = {"median_outlier_score": 0.5, "p95_outlier_score": 0.95}
    ranks = exact_percentiles(scored, by, score, fractions, max_group_rows=max_group_rows)
    return beside(counts, ranks, by, "left")


def summarize(
    scored: DataFrame, by: Sequence[str] = (), score: str = SCORE, prediction: str = PREDICTION,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, n_windows, min, mean, median, max score, outlier_window_ratio)``."""
    scored = once(scored.select(*by, score, prediction))
    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min(score).alias("min_score"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
        F.avg(prediction).alias("outlier_window_ratio"),
    )
    ranks = exact_percentiles(scored, by, score, {"median_score": 0.5}, max_group_rows=max_group_rows)
    return beside(counts, ranks, by, "left").select(
        *by, "n_windows", "min_score", "mean_score", "median_score", "max_score", "outlier_window_ratio"
    )


def top_entities(rolled: DataFrame, entity: str, k: int = 10, score: str = "max_score") -> DataFrame:
    """The k entities with the highest score, ties by id."""
    return rolled.orderBy(F.desc(score), entity).limit(k)

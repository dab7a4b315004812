"""Comparison of models inside a run and across runs.

A metric row has ``run_name``, ``model`` and the metrics of one evaluation.
These tables have one row per run, model and split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.expressions import run_order, run_size

# Metrics and times that reports show.
METRICS = ("precision", "recall", "f1_score", "pr_auc", "roc_auc")
TIMES = ("training_time_seconds", "inference_time_seconds")


def union_metrics(parts: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of different shape under one header."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_models(metrics: DataFrame, expected: DataFrame, model: str = "model") -> DataFrame:
    """``(model)`` of the expected models without a metric row."""
    return expected.select(model).distinct().join(metrics.select(model), model, "left_anti")


def require_models(metrics: DataFrame, expected: DataFrame, allow_partial: bool = False) -> None:
    """Fail, naming the models, unless every expected model was evaluated."""
    absent = [] if allow_partial else [r[0] for r in missing_models(metrics, expected).orderBy("model").collect()]
    if absent:
        raise RuntimeError("no metrics for: " + ", ".join(absent))


def best_model(metrics: DataFrame, metric: str = "pr_auc", by: Sequence[str] = ("run_name",)) -> DataFrame:
    """The row with the highest metric per run; null counts as -1, the first model name wins a tie.

    ``max_by`` keeps one candidate per task, so a run with very many rows is not
    gathered in one task first.
    """
    everything = F.struct(*[F.col(c) for c in metrics.columns])
    # Smallest (-value, model) is the winner.
    key = F.struct((-F.coalesce(F.col(metric), F.lit(-1.0))).alias("worse"), F.col("model").alias("model"))
    best = metrics.groupBy(*by).agg(F.min_by(everything, key).alias("_best"))
    return best.select("_best.*")


def ordered_runs(metrics: DataFrame) -> DataFrame:
    """``(position, run_name, debug_entities)``: sized runs by size, the complete run, then the rest by name."""
    runs = metrics.select("run_name").distinct().withColumn("_order", run_order("run_name"))
    # One row per run.
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_order"))
    return runs.select(position.alias("position"), "run_name", run_size("run_name").alias("debug_entities"))


def ranked(metrics: DataFrame, metric: str = "f1_score") -> DataFrame:
    """Metric rows, best first, rows without the metric last."""
    return metrics.orderBy(F.desc_nulls_last(metric), "model")


def ordered_metrics(metrics: DataFrame) -> DataFrame:
    """All metric rows with the ``position`` of their run, in run order, then by model."""
    return metrics.join(ordered_runs(metrics).select("position", "run_name"), "run_name").orderBy("position", "model")


def metric_by_run(metrics: DataFrame, metric: str, models: Sequence[str] | None = None) -> DataFrame:
    """One row per run in run order, one column per model."""
    known = metrics.where(F.col(metric).isNotNull())
    pivoted = known.groupBy("run_name").pivot("model", list(models) if models else None).agg(F.max(metric))
    return pivoted.orderBy(run_order("run_name"))


def _unpivot(metrics: DataFrame, columns: Sequence[str], name: str, value: str, keys: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in metrics.columns]
    numbers = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in present])
    return numbers.unpivot(list(keys), present, name, value)


def metric_table(metrics: DataFrame, keys: Sequence[str] = ("model",), columns: Sequence[str] = METRICS) -> DataFrame:
    """``(keys…, metric, value)``; null where a metric is undefined."""
    return _unpivot(metrics, columns, "metric", "value", keys)


def runtime_table(metrics: DataFrame, keys: Sequence[str] = ("model",), columns: Sequence[str] = TIMES) -> DataFrame:
    """``(keys…, phase, seconds)``; an unknown time is 0."""
    table = _unpivot(metrics, columns, "phase", "seconds", keys)
    return table.withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def run_comparison(metrics: DataFrame, expected: DataFrame | None = None, allow_partial: bool = False) -> DataFrame:
    """Metric rows of one run with flags for the best PR-AUC and the best F1."""
    if expected is not None:
        require_models(metrics, expected, allow_partial)
    flagged = metrics
    for metric, flag in (("pr_auc", "best_by_pr_auc"), ("f1_score", "best_by_f1")):
        best = best_model(metrics, metric, by=[]).select(F.col("model"), F.lit(True).alias(flag))
        flagged = flagged.join(F.broadcast(best), "model", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return flagged


def study_summary(metrics: DataFrame) -> DataFrame:
    """Best model of every run by PR-AUC with its metrics, in run order."""
    kept = [c for c in (*METRICS, *TIMES) if c in metrics.columns]
    best = best_model(metrics, "pr_auc")
    return best.orderBy(run_order("run_name")).select(
        "run_name",
        run_size("run_name").alias("debug_entities"),
        F.col("model").alias("best_model_by_pr_auc"),
        *kept,
    )

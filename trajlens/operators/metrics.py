"""Classification and ranking metrics of labelled scores, one row or curve per group.

Rows with a negative or missing label do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions.expressions import is_finite
from trajlens.operators.ordering import MAX_GROUP_ROWS, beside, running_totals, settled


def labelled(scores: DataFrame, label: str = "y_true", score: str | None = None) -> DataFrame:
    """Rows with a known label and, when a score is named, a finite score."""
    rows = scores.where(F.col(label) >= 0)
    return rows if score is None else rows.where(is_finite(F.col(score).cast("double")))


def _ratio(top: Column, bottom: Column) -> Column:
    """0 instead of a division by zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_metrics(
    scores: DataFrame, label: str = "y_true", prediction: str = "is_outlier", by: Sequence[str] = ()
) -> DataFrame:
    """Counts, precision, recall, F1 and the four confusion cells.

    Ratios are 0 on an empty denominator and null without rows; the cells are
    null when only one class is present.
    """
    y, p = F.col(label), F.col(prediction)
    counts = labelled(scores, label).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(y == 1).alias("n_outliers"),
        F.count_if(y == 0).alias("n_normals"),
        F.count_if(p == 1).alias("n_predicted_outliers"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    some = F.col("n_samples") > 0
    both = (F.col("n_outliers") > 0) & (F.col("n_normals") > 0)
    return counts.select(
        *by,
        "n_samples",
        "n_outliers",
        "n_normals",
        "n_predicted_outliers",
        F.when(some, _ratio(tp, tp + fp)).alias("precision"),
        F.when(some, _ratio(tp, tp + fn)).alias("recall"),
        F.when(some, _ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
        *[F.when(both, F.col(c)).alias(c) for c in ("tn", "fp", "fn", "tp")],
    )


def confusion_matrix(
    scores: DataFrame, label: str = "y_true", prediction: str = "is_outlier", by: Sequence[str] = ()
) -> DataFrame:
    """``(by…, y_true, y_pred, count)``: always four cells per group."""
    y, p = F.col(label), F.col(prediction)
    cells = [
        F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.count_if((y == a) & (p == b)).alias("count"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    counted = labelled(scores, label).groupBy(*by).agg(F.array(*cells).alias("_cells"))
    return counted.select(*by, F.inline("_cells"))


# A ranking needs both classes.
_BOTH = "_positives > 0 AND _negatives > 0"


def _ranked(
    scores: DataFrame, score: str, label: str, by: Sequence[str], max_group_rows: int | None
) -> tuple[DataFrame, DataFrame]:
    """One row per distinct score, highest first, with its class counts, running totals and group totals.

    Only groups that have both classes are ranked. Also the totals of all groups. The
    input is evaluated once: all of it comes from the stored table of distinct scores.
    """
    rows = labelled(scores, label, score).select(
        *by, F.col(score).cast("double").alias("_s"), (F.col(label) == 1).cast("long").alias("_y")
    )
    # -0.0 and 0.0 are one score
    distinct = settled(
        rows.groupBy(*by, (F.col("_s") + F.lit(0.0)).alias("_s")).agg(
            F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q")
        )
    )
    ordered = distinct.withColumn("_key", -F.col("_s"))
    running = running_totals(ordered, by, ["_key"], {"_tp": "_p", "_fp": "_q"}, max_group_rows)
    totals = distinct.groupBy(*by).agg(F.sum("_p").alias("_positives"), F.sum("_q").alias("_negatives"))
    return beside(running, totals, by).where(_BOTH), totals


def ranking_metrics(
    scores: DataFrame,
    score: str,
    label: str = "y_true",
    by: Sequence[str] = (),
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, roc_auc, pr_auc)`` from one ranking; both null when only one class is present.

    ROC-AUC counts a tie as half. PR-AUC is average precision, the step sum.
    """
    ranked, totals = _ranked(scores, score, label, by, max_group_rows)
    # Positives above a negative count fully, positives in the same score half.
    above = F.col("_tp") - F.col("_p")
    pairs = F.sum(F.col("_q") * (above + F.col("_p") / F.lit(2.0)))
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    positives, negatives = F.max("_positives").cast("double"), F.max("_negatives").cast("double")
    found = ranked.groupBy(*by).agg(
        (pairs / (positives * negatives)).alias("roc_auc"),
        F.sum(F.col("_p") / F.col("_positives") * precision).alias("pr_auc"),
    )
    if not by:
        return found
    return beside(totals.select(*by), found, by, "left")


def roc_auc(scores: DataFrame, score: str, label: str = "y_true", by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(scores, score, label, by, **kw).select(*by, "roc_auc")


def average_precision(scores: DataFrame, score: str, label: str = "y_true", by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(scores, score, label, by, **kw).select(*by, "pr_auc")


def pr_curve(
    scores: DataFrame,
    score: str,
    label: str = "y_true",
    by: Sequence[str] = (),
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, threshold, precision, recall)`` per distinct score, with the end point (null, 1, 0)."""
    ranked, groups = _ranked(scores, score, label, by, max_group_rows)
    points = ranked.select(
        *by,
        F.col("_s").alias("threshold"),
        (F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("precision"),
        (F.col("_tp") / F.col("_positives")).alias("recall"),
    )
    end = groups.where(_BOTH).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def roc_curve(
    scores: DataFrame,
    score: str,
    label: str = "y_true",
    by: Sequence[str] = (),
    drop_collinear: bool = False,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(by…, threshold, fpr, tpr)`` per distinct score, with the start point (infinity, 0, 0).

    ``drop_collinear`` leaves out points whose neighbours lie on one line with
    them: the counts added at the point and at the next one are equal.
    """
    ranked, groups = _ranked(scores, score, label, by, max_group_rows)
    if drop_collinear:
        following = ranked.select(
            *by,
            (F.col("_idx") - 1).alias("_idx"),
            F.col("_p").alias("_next_p"),
            F.col("_q").alias("_next_q"),
        )
        ranked = ranked.join(following, [*by, "_idx"], "left").where(
            F.col("_next_p").isNull() | (F.col("_next_p") != F.col("_p")) | (F.col("_next_q") != F.col("_q"))
        )
    points = ranked.select(
        *by,
        F.col("_s").alias("threshold"),
        (F.col("_fp") / F.col("_negatives")).alias("fpr"),
        (F.col("_tp") / F.col("_positives")).alias("tpr"),
    )
    start = groups.where(_BOTH).select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


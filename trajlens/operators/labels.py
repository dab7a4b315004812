"""Entity labels: binarise, summarise, attach."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.functions.expressions import binary_label

# Label column names, in order of preference.
LABEL_CANDIDATES = (
    "class_label",
    "in_study_repair",
    "is_outlier",
    "outlier",
    "label",
    "target",
    "is_anomaly",
    "anomaly",
    "repair",
    "failure",
)
UNLABELLED = -1


def infer_label_column(df: DataFrame, candidates: Sequence[str] = LABEL_CANDIDATES) -> str:
    present = [name for name in candidates if name in df.columns]
    if not present:
        raise ValueError(f"no label column among {list(candidates)}")
    return present[0]


def entity_labels(labels: DataFrame, entity: str, label_col: str | None = None, output: str = "y_true") -> DataFrame:
    """``(entity, output)``: 1 when any row of the entity is positive; null if all its labels are null."""
    label_col = label_col or infer_label_column(labels)
    return labels.groupBy(entity).agg(F.max(binary_label(label_col)).alias(output))


def attach_labels(
    readouts: DataFrame,
    labels: DataFrame,
    entity: str,
    label_col: str | None = None,
    output: str = "y_true",
    unlabelled: int = UNLABELLED,
) -> DataFrame:
    """Left join of the entity label; entities without one get ``unlabelled``.

    The label side has one row per entity. When it is too large for an automatic
    broadcast, adaptive execution splits a skewed readout partition.
    """
    known = entity_labels(labels, entity, label_col, output)
    joined = readouts.drop(output).join(known, entity, "left")
    return joined.withColumn(output, F.coalesce(output, F.lit(unlabelled)).cast("int"))


def normal_entities(labels: DataFrame, entity: str, label_col: str) -> DataFrame:
    """Distinct entities that have a row with label 0."""
    if label_col not in labels.columns:
        raise ValueError(f"column {label_col!r} is needed to pick normal entities")
    return labels.where(F.col(label_col).try_cast("int") == 0).select(entity).distinct()


def keep_normal(readouts: DataFrame, labels: DataFrame, entity: str, label_col: str = "in_study_repair") -> DataFrame:
    """Rows of the normal entities."""
    return readouts.join(normal_entities(labels, entity, label_col), entity, "left_semi")


def _binary_counts() -> list:
    y = F.col("y_true")
    total = F.count(y)
    return [
        F.count_if(y == 0).alias("normal"),
        F.count_if(y == 1).alias("positive"),
        total.alias("total"),
        F.try_divide(F.count_if(y == 1).cast("double"), total).alias("positive_ratio"),
    ]


def label_summary(labels: DataFrame, entity: str, label_col: str | None = None) -> DataFrame:
    """``(total_labeled, normal, positive, positive_ratio, label_column)``; null labels do not count."""
    label_col = label_col or infer_label_column(labels)
    counts = entity_labels(labels, entity, label_col).agg(*_binary_counts())
    return counts.select(
        F.col("total").alias("total_labeled"),
        "normal",
        "positive",
        "positive_ratio",
        F.lit(label_col).alias("label_column"),
    )


def class_distribution(tables: Mapping[str, DataFrame], class_col: str = "class_label") -> DataFrame:
    """``(source, class_label, count)`` of the classes before they are made binary."""
    parts = [
        df.select(F.lit(source).alias("source"), F.col(class_col).try_cast("int").alias("class_label"))
        for source, df in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).where(F.col("class_label").isNotNull())
    return rows.groupBy("source", "class_label").agg(F.count(F.lit(1)).alias("count"))


def binary_distribution(
    tables: Mapping[str, DataFrame], entity: str, label_cols: Mapping[str, str] | None = None
) -> DataFrame:
    """``(source, normal, outlier_or_repair, total, positive_ratio)`` over entities."""
    label_cols = label_cols or {}
    parts = [
        entity_labels(df, entity, label_cols.get(source)).select(F.lit(source).alias("source"), "y_true")
        for source, df in tables.items()
    ]
    counts = reduce(DataFrame.unionByName, parts).groupBy("source").agg(*_binary_counts())
    return counts.withColumnRenamed("positive", "outlier_or_repair")

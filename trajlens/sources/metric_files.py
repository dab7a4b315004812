"""Metric records that runs left behind as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.functions.expressions import run_size

# Layout of a runs folder and columns of a metric record.
METRIC_GLOB = "*/metrics/*_metrics.json"
ENTITY_LEVEL = "vehicle"
METRIC_SCHEMA = (
    "model string, split string, level string, threshold double, n_samples long, n_outliers long, "
    "n_normals long, n_predicted_outliers long, precision double, recall double, f1_score double, "
    "roc_auc double, pr_auc double, tn long, fp long, fn long, tp long, "
    "training_time_seconds double, inference_time_seconds double, _corrupt_record string"
)


def read_metrics(
    spark: SparkSession, runs_dir: str, level: str | None = ENTITY_LEVEL, pattern: str = METRIC_GLOB
) -> DataFrame:
    """One row per metric file with ``run_name``, ``debug_entities`` and ``metric_file``; bad files are skipped.

    Known keys are typed columns; all others are kept as text in the map ``other_keys``.
    """
    text = spark.read.text(f"{runs_dir.rstrip('/')}/{pattern}", wholetext=True)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    record = F.from_json("value", METRIC_SCHEMA, options)
    known = [field.split()[0] for field in METRIC_SCHEMA.split(", ")]
    other = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(known))
    rows = text.select(F.col("_metadata.file_path").alias("metric_file"), record.alias("record"), other.alias("other_keys"))
    rows = rows.select("record.*", "other_keys", "metric_file")
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("model").isNotNull()).drop("_corrupt_record")
    if level is not None:
        good = good.where(F.col("level") == level)
    run = F.regexp_extract("metric_file", r"([^/]+)/metrics/[^/]+$", 1)
    return good.withColumn("run_name", run).withColumn("debug_entities", run_size("run_name"))

"""Plans stay the ones we want: few shuffles, pruned scans, no nested loops."""

from __future__ import annotations

import re

import pytest
from checks import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__
from trajlens.models import MeanProfile
from trajlens.operators import labels, profile, scoring, windows
from trajlens.queries.bindings import ROLES, classes, readouts, scores

QUERIES = __spark_entry__.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|round|single)", text, re.IGNORECASE))


def test_windows_need_one_shuffle(spark):
    built = windows.build_windows(readouts(spark, SF_DIR), ["price"], "entity_id", "t")
    text = plan(built)
    assert shuffles(text) == 1
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_scoring_adds_no_shuffle(spark):
    import numpy as np

    built = windows.build_windows(readouts(spark, SF_DIR), ["price"], "entity_id", "t")
    assert shuffles(plan(scoring.score_windows(built, MeanProfile(np.zeros((30, 1))), "entity_id"))) == 1


def test_labels_and_windows_share_the_shuffle_of_a_big_join(spark):
    """With both sides too large to broadcast, readouts are still shuffled once."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, known = readouts(spark, SF_DIR), classes(spark, SF_DIR).withColumn("entity_id", F.col("entity_id") + 0)
        attached = labels.attach_labels(rows, known, ROLES.entity)
        joined = shuffles(plan(attached))
        built = windows.build_windows(attached, ["price"], "entity_id", "t", "y_true", max_group_rows=None)
        assert shuffles(plan(built)) == joined
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_histogram_shuffles_counts_only(spark):
    text = plan(profile.histogram(scores(spark, SF_DIR), ["outlier_score"], by=["model"]))
    assert shuffles(text) == 1 and "HashAggregate" in text


@pytest.mark.parametrize("name", ["threshold_best_f1", "threshold_best_f1_by_model", "histogram", "pr_curve", "roc_auc", "boxplot_stats", "run_comparison", "write_windows"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in text and "CartesianProduct" not in text

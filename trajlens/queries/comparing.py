"""Queries over metric rows of several models and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions.expressions import sanitize_run_name
from trajlens.operators import compare
from trajlens.operators.ordering import large_groups, with_position
from trajlens.queries.bindings import METRIC_ROWS, metric_rows, table
from trajlens.queries.registry import query

_COLUMNS = (
    "run_name, model, precision, recall, f1_score, roc_auc, pr_auc, training_time_seconds, inference_time_seconds"
)


def _best_sql(metric: str) -> str:
    return f"""WITH {METRIC_ROWS}, b AS (
      SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY coalesce({metric}, -1) DESC, model) AS rn FROM metric_rows)
    SELECT run_name, model, level, precision, recall, f1_score, roc_auc, pr_auc, training_time_seconds, inference_time_seconds
    FROM b WHERE rn = 1"""


@query("best_model", _best_sql("pr_auc"))
def best_model(spark, sf):
    return compare.best_model(metric_rows(spark, sf))


@query("best_model_f1", _best_sql("f1_score"))
def best_model_f1(spark, sf):
    return compare.best_model(metric_rows(spark, sf), "f1_score")


_RUN_KEY = """CASE WHEN regexp_full_match(run_name, 'debug_[0-9]+') THEN 0 WHEN run_name = 'full' THEN 1 ELSE 2 END,
  coalesce(TRY_CAST(nullif(regexp_extract(run_name, '^debug_([0-9]+)$', 1), '') AS BIGINT), 0), run_name"""


@query(
    "run_order",
    f"""WITH {METRIC_ROWS} SELECT CAST(row_number() OVER (ORDER BY {_RUN_KEY}) AS INTEGER) AS position, run_name,
          TRY_CAST(nullif(regexp_extract(run_name, '^debug_([0-9]+)$', 1), '') AS BIGINT) AS debug_entities
        FROM (SELECT DISTINCT run_name FROM metric_rows)""",
)
def run_order(spark, sf):
    return compare.ordered_runs(metric_rows(spark, sf))


@query(
    "sanitize_run_name",
    """SELECT DISTINCT p_name || ' / ' || p_brand || '..' AS raw,
         trim(regexp_replace(trim(p_name || ' / ' || p_brand || '..'), '[^A-Za-z0-9_.\\-]+', '_', 'g'), '._-') AS clean FROM part""",
)
def sanitize(spark, sf):
    raw = F.concat("p_name", F.lit(" / "), "p_brand", F.lit(".."))
    names = table(spark, sf, "part").select(raw.alias("raw")).distinct()
    return names.select("raw", sanitize_run_name("raw").alias("clean"))


@query(
    "metric_by_run",
    f"""WITH {METRIC_ROWS} SELECT run_name, max(pr_auc) FILTER (model = 'A') AS "A", max(pr_auc) FILTER (model = 'N') AS "N",
          max(pr_auc) FILTER (model = 'R') AS "R" FROM metric_rows WHERE pr_auc IS NOT NULL GROUP BY run_name""",
)
def metric_by_run(spark, sf):
    return compare.metric_by_run(metric_rows(spark, sf), "pr_auc")


@query(
    "metric_table",
    f"""WITH {METRIC_ROWS} SELECT run_name, model, unnest(['precision', 'recall', 'f1_score', 'pr_auc', 'roc_auc']) AS metric,
          unnest([precision, recall, f1_score, pr_auc, roc_auc]) AS value FROM metric_rows""",
)
def metric_table(spark, sf):
    return compare.metric_table(metric_rows(spark, sf), keys=["run_name", "model"])


@query(
    "runtime_table",
    f"""WITH {METRIC_ROWS} SELECT run_name, model, unnest(['training_time_seconds', 'inference_time_seconds']) AS phase,
          unnest([coalesce(training_time_seconds, 0), coalesce(inference_time_seconds, 0)]) AS seconds FROM metric_rows""",
)
def runtime_table(spark, sf):
    return compare.runtime_table(metric_rows(spark, sf), keys=["run_name", "model"])


@query(
    "ranked_metrics",
    f"""WITH {METRIC_ROWS} SELECT run_name, model, f1_score, row_number() OVER (ORDER BY f1_score DESC NULLS LAST, model, run_name) - 1 AS place
        FROM metric_rows""",
)
def ranked_metrics(spark, sf):
    ranked = compare.ranked(metric_rows(spark, sf)).select("run_name", "model", "f1_score")
    rows = ranked.select("*", F.col("f1_score").isNull().alias("_missing"), (-F.col("f1_score")).alias("_worst"))
    order = ["_missing", "_worst", "model", "run_name"]
    # Numbered in sorted slices, as a group of any size is.
    placed = with_position(rows, [], order, "place", large_groups(rows, [], 0))
    return placed.select("run_name", "model", "f1_score", "place")


@query(
    "ordered_metrics",
    f"""WITH {METRIC_ROWS}, runs AS (
          SELECT run_name, row_number() OVER (ORDER BY n IS NULL, n, run_name <> 'full', run_name) AS position FROM (
            SELECT DISTINCT run_name, TRY_CAST(nullif(regexp_extract(run_name, '^debug_([0-9]+)$', 1), '') AS BIGINT) AS n FROM metric_rows))
        SELECT position, run_name, model, f1_score FROM metric_rows JOIN runs USING (run_name)""",
)
def ordered_metrics(spark, sf):
    return compare.ordered_metrics(metric_rows(spark, sf)).select("position", "run_name", "model", "f1_score")


@query(
    "missing_models",
    f"""WITH {METRIC_ROWS} SELECT DISTINCT e.model FROM (SELECT l_returnflag AS model FROM lineitem UNION SELECT l_linestatus FROM lineitem) e
        WHERE e.model NOT IN (SELECT model FROM metric_rows)""",
)
def missing_models(spark, sf):
    lines = table(spark, sf, "lineitem")
    expected = lines.select(F.col("l_returnflag").alias("model")).union(lines.select("l_linestatus"))
    return compare.missing_models(metric_rows(spark, sf), expected)


@query(
    "union_metrics",
    f"""WITH {METRIC_ROWS} SELECT run_name, model, precision, NULL AS n_windows FROM metric_rows
        UNION ALL SELECT NULL, l_returnflag, NULL, count(*) FROM lineitem GROUP BY l_returnflag""",
)
def union_metrics(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count(F.lit(1)).alias("n_windows")
    )
    return compare.union_metrics([metric_rows(spark, sf).select("run_name", "model", "precision"), counts])


@query(
    "run_comparison",
    f"""WITH {METRIC_ROWS}, f AS (SELECT * FROM metric_rows WHERE run_name = 'full')
        SELECT {_COLUMNS}, row_number() OVER (ORDER BY coalesce(pr_auc, -1) DESC, model) = 1 AS best_by_pr_auc,
               row_number() OVER (ORDER BY coalesce(f1_score, -1) DESC, model) = 1 AS best_by_f1 FROM f""",
)
def run_comparison(spark, sf):
    full = metric_rows(spark, sf).where(F.col("run_name") == "full")
    expected = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"))
    return compare.run_comparison(full, expected).drop("level")


@query(
    "study_summary",
    f"""WITH {METRIC_ROWS}, b AS (
          SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY coalesce(pr_auc, -1) DESC, model) AS rn FROM metric_rows)
        SELECT run_name, TRY_CAST(nullif(regexp_extract(run_name, '^debug_([0-9]+)$', 1), '') AS BIGINT) AS debug_entities,
               model AS best_model_by_pr_auc, precision, recall, f1_score, pr_auc, roc_auc,
               training_time_seconds, inference_time_seconds FROM b WHERE rn = 1""",
)
def study_summary(spark, sf):
    return compare.study_summary(metric_rows(spark, sf))



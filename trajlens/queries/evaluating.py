"""Queries over metrics of labelled scores, and the evaluation steps."""

from __future__ import annotations

from trajlens.models import MeanProfile
from trajlens.operators import metrics
from trajlens.plans import evaluate, fit_and_threshold, prepare, PrepareConfig
from trajlens.queries.bindings import (
    MEAN_SCORES,
    PART_SCORES,
    ROLES,
    SCORES,
    classes,
    nearest,
    part_scores,
    repairs,
    rounded,
    scores,
    splits,
)
from trajlens.queries.registry import query


def _metrics_sql(rows: str, key: str) -> str:
    """Counts and ratios per group of the labelled rows, as table m."""
    return f"""{rows}, c AS (
      SELECT {key} AS model, count(*) AS n, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg,
             count(*) FILTER (is_outlier = 1) AS predicted,
             count(*) FILTER (y_true = 0 AND is_outlier = 0) AS tn, count(*) FILTER (y_true = 0 AND is_outlier = 1) AS fp,
             count(*) FILTER (y_true = 1 AND is_outlier = 0) AS fn, count(*) FILTER (y_true = 1 AND is_outlier = 1) AS tp
      FROM labelled GROUP BY 1),
    m AS (
      SELECT model, n AS n_samples, pos AS n_outliers, neg AS n_normals, predicted AS n_predicted_outliers,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1_score,
             CASE WHEN pos > 0 AND neg > 0 THEN tn END AS tn, CASE WHEN pos > 0 AND neg > 0 THEN fp END AS fp,
             CASE WHEN pos > 0 AND neg > 0 THEN fn END AS fn, CASE WHEN pos > 0 AND neg > 0 THEN tp END AS tp
      FROM c)"""


_LABELLED = SCORES + ", labelled AS (SELECT * FROM scores WHERE y_true >= 0)"
_LABELLED_PARTS = PART_SCORES + ", labelled AS (SELECT * FROM part_scores WHERE y_true >= 0)"


@query("binary_metrics", "WITH " + _metrics_sql(_LABELLED_PARTS, "'all'") + " SELECT * EXCLUDE (model) FROM m")
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(part_scores(spark, sf)))


@query("binary_metrics_by_model", "WITH " + _metrics_sql(_LABELLED, "model") + " SELECT * FROM m")
def binary_metrics_by_model(spark, sf):
    return rounded(metrics.binary_metrics(scores(spark, sf), by=["model"]))


@query(
    "confusion_matrix",
    f"""WITH {_LABELLED}, cells AS (
          SELECT m.model, a.y AS y_true, b.y AS y_pred FROM (SELECT DISTINCT model FROM labelled) m,
                 (VALUES (0), (1)) AS a(y), (VALUES (0), (1)) AS b(y)),
        c AS (SELECT model, y_true, is_outlier AS y_pred, count(*) AS n FROM labelled GROUP BY 1, 2, 3)
        SELECT model, y_true, y_pred, coalesce(n, 0) AS count FROM cells LEFT JOIN c USING (model, y_true, y_pred)""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(scores(spark, sf), by=["model"])


def _ranking_sql(rows: str, key: str) -> str:
    """Class counts per distinct score, running totals from the highest score down."""
    return f"""{rows}, d AS (
      SELECT {key} AS model, outlier_score AS s, sum(y_true) AS p, sum(1 - y_true) AS q FROM labelled GROUP BY 1, 2),
    k AS (
      SELECT model, s, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q,
             CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(q) OVER w AS DOUBLE) AS fp,
             CAST(sum(p) OVER (PARTITION BY model) AS DOUBLE) AS pos, CAST(sum(q) OVER (PARTITION BY model) AS DOUBLE) AS neg
      FROM d WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


_RANKED = """ SELECT model, round(sum(q * (tp - p + p / 2)) / (any_value(pos) * any_value(neg)), 6) AS roc_auc,
       round(sum(p / pos * (tp / (tp + fp))), 6) AS pr_auc FROM k WHERE pos > 0 AND neg > 0 GROUP BY model"""


@query("roc_auc", "WITH " + _ranking_sql(_LABELLED_PARTS, "'all'") + f", r AS ({_RANKED}) SELECT roc_auc FROM r")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(part_scores(spark, sf), "outlier_score"))


@query("average_precision", "WITH " + _ranking_sql(_LABELLED_PARTS, "'all'") + f", r AS ({_RANKED}) SELECT pr_auc FROM r")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(part_scores(spark, sf), "outlier_score"))


@query("ranking_metrics_by_model", "WITH " + _ranking_sql(_LABELLED, "model") + _RANKED)
def ranking_metrics_by_model(spark, sf):
    return rounded(metrics.ranking_metrics(scores(spark, sf), "outlier_score", by=["model"]))


@query(
    "pr_curve",
    "WITH "
    + _ranking_sql(_LABELLED, "model")
    + """ SELECT model, s AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM k
          UNION ALL SELECT DISTINCT model, NULL, 1.0, 0.0 FROM k""",
)
def pr_curve(spark, sf):
    curve = metrics.pr_curve(scores(spark, sf), "outlier_score", by=["model"])
    return curve.select("model", "threshold", nearest("precision", 6).alias("precision"), nearest("recall", 6).alias("recall"))


@query(
    "roc_curve",
    "WITH "
    + _ranking_sql(_LABELLED, "model")
    + """ SELECT model, s AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM k
          UNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM k""",
)
def roc_curve(spark, sf):
    curve = metrics.roc_curve(scores(spark, sf), "outlier_score", by=["model"])
    return curve.select("model", "threshold", nearest("fpr", 6).alias("fpr"), nearest("tpr", 6).alias("tpr"))


@query(
    "roc_curve_reduced",
    "WITH "
    + _ranking_sql(_LABELLED_PARTS, "'all'")
    + """, n AS (SELECT *, lead(p) OVER (ORDER BY s DESC) AS np, lead(q) OVER (ORDER BY s DESC) AS nq FROM k)
         SELECT s AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM n
         WHERE np IS NULL OR np <> p OR nq <> q UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0""",
)
def roc_curve_reduced(spark, sf):
    curve = metrics.roc_curve(part_scores(spark, sf), "outlier_score", drop_collinear=True)
    return curve.select("threshold", nearest("fpr", 6).alias("fpr"), nearest("tpr", 6).alias("tpr"))


# --- steps -----------------------------------------------------------------

_ROLLED = (
    MEAN_SCORES
    + """, rolled AS (
  SELECT p.split, w.entity_id, max(score) AS max_score, count(*) AS n_windows, any_value(y) AS y_true
  FROM window_scores w JOIN splits p USING (entity_id) JOIN entity_y e USING (entity_id) GROUP BY 1, 2),
s AS (SELECT max_score AS v, y_true AS p FROM rolled WHERE split = 'validation'),
r AS (SELECT min(v) AS lo, max(v) AS hi, sum(p) AS positives, count(*) AS total FROM s),
g AS (SELECT positives, i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199.0::DOUBLE) END AS t
      FROM r, range(200) AS x(i) WHERE positives > 0 AND positives < total),
f AS (SELECT i, t, coalesce(sum(p) FILTER (v > t), 0) AS tp, count(*) FILTER (v > t) AS above, any_value(positives) AS positives
      FROM g, s GROUP BY i, t),
ranked AS (SELECT t, row_number() OVER (ORDER BY CAST(2 * tp AS DOUBLE) / (positives + above) DESC, t) AS rn FROM f),
limits AS (
  SELECT t AS threshold FROM ranked WHERE rn = 1
  UNION ALL SELECT quantile_cont(v, 0.95) FROM s HAVING sum(p) = 0 OR sum(p) = count(*))"""
)


_TESTED = (
    _ROLLED
    + """, labelled AS (
  SELECT max_score AS outlier_score, y_true, CAST(max_score > threshold AS INTEGER) AS is_outlier
  FROM rolled, limits WHERE split = 'test')"""
)


def _prepared(spark, sf):
    rows, known = splits(spark, sf), classes(spark, sf)
    return prepare(
        rows["train"], rows["validation"], rows["test"], repairs(spark, sf), known, known,
        ROLES, PrepareConfig(dtype="double"),
    )


@query(
    "fit_and_threshold",
    f"""WITH {_ROLLED} SELECT 'mean_profile' AS model, round(threshold, 6) AS threshold, 'max_score' AS score_col,
          'validation' AS selection_split, 'vehicle' AS selection_level FROM limits""",
)
def fit_and_threshold_query(spark, sf):
    prepared = _prepared(spark, sf)
    _, limits = fit_and_threshold(
        {"mean_profile": MeanProfile.fit}, prepared.windows["validation"], "entity_id",
        train_windows=prepared.windows["train"],
    )
    return rounded(limits.drop("training_time_seconds"))


@query(
    "evaluate",
    "WITH "
    + _ranking_sql(_metrics_sql(_TESTED, "'mean_profile'"), "'mean_profile'")
    + f""", ranks AS ({_RANKED})
          SELECT m.*, roc_auc, pr_auc, round(threshold, 6) AS threshold, 'test' AS split, 'vehicle' AS level
          FROM m LEFT JOIN ranks USING (model), limits""",
)
def evaluate_query(spark, sf):
    prepared = _prepared(spark, sf)
    models, limits = fit_and_threshold(
        {"mean_profile": MeanProfile.fit}, prepared.windows["validation"], "entity_id",
        train_windows=prepared.windows["train"],
    )
    result = evaluate(models, limits, prepared.windows["test"], "entity_id")
    return rounded(result.metrics.drop("training_time_seconds", "inference_time_seconds"))

"""Queries over models, window scores and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.models import DenseAutoencoder, MeanProfile, PcaLocal, PcaWindow, loss
from trajlens.operators import scoring, thresholds
from trajlens.operators.labels import keep_normal
from trajlens.operators.ordering import checkpointed
from trajlens.queries.bindings import (
    MEAN_SCORES,
    PART_SCORES,
    SCORES,
    fitted,
    nearest,
    part_scores,
    readouts,
    repairs,
    rounded,
    scores,
    split_windows,
    splits,
    train_rows,
)
from trajlens.queries.registry import query

# --- reconstruction scores -------------------------------------------------


def mean_profile_scores(spark, sf):
    """Scores of every window of every supplier under the profile of the train windows."""
    parameters = fitted(spark, sf)
    model = MeanProfile.fit(split_windows(spark, sf, train_rows(spark, sf), parameters))
    return scoring.score_windows(split_windows(spark, sf, readouts(spark, sf), parameters), model, "entity_id")


@query(
    "score_windows_mean_profile",
    f"""WITH {MEAN_SCORES} SELECT entity_id || '_' || start_idx AS window_id, entity_id, start_t AS start_time_step,
          end_t AS end_time_step, -1 AS y_true, round(score, 6) AS outlier_score FROM window_scores""",
)
def score_windows_mean_profile(spark, sf):
    return rounded(mean_profile_scores(spark, sf))


@query(
    "reconstruction_loss",
    f"WITH {MEAN_SCORES} SELECT round(avg(score), 6) AS loss FROM window_scores",
)
def reconstruction_loss(spark, sf):
    parameters = fitted(spark, sf)
    model = MeanProfile.fit(split_windows(spark, sf, train_rows(spark, sf), parameters))
    value = loss(split_windows(spark, sf, readouts(spark, sf), parameters), model)
    return spark.range(1).select(nearest(F.lit(value), 6).alias("loss"))


def _model_scores(spark, sf, fit):
    parameters = fitted(spark, sf)
    train = checkpointed(split_windows(spark, sf, train_rows(spark, sf), parameters))
    built = split_windows(spark, sf, readouts(spark, sf), parameters)
    return scoring.score_windows(built, fit(train), "entity_id")


def _normal_validation(spark, sf):
    rows = keep_normal(splits(spark, sf)["validation"], repairs(spark, sf), "entity_id")
    return checkpointed(split_windows(spark, sf, rows, fitted(spark, sf)))


@query("score_windows_pca_window")
def score_windows_pca_window(spark, sf):
    return _model_scores(spark, sf, lambda train: PcaWindow.fit(train, k=8))


@query("score_windows_pca_local")
def score_windows_pca_local(spark, sf):
    return _model_scores(spark, sf, lambda train: PcaLocal.fit(train, k=4))


@query("score_windows_dense_ae")
def score_windows_dense_ae(spark, sf):
    return _model_scores(spark, sf, lambda train: DenseAutoencoder.fit(train, _normal_validation(spark, sf)))


_FLAGSHIP = f"""WITH {MEAN_SCORES}, rolled AS (
  SELECT entity_id, max(score) AS max_score, avg(score) AS mean_score, median(score) AS median_score,
         quantile_cont(score, 0.95) AS p95_score, count(*) AS n_windows FROM window_scores GROUP BY 1),
limits AS (SELECT quantile_cont(max_score, 0.95) AS threshold FROM rolled)"""


@query(
    "top_entities",
    _FLAGSHIP
    + """ SELECT entity_id, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score,
            round(median_score, 6) AS median_score, round(p95_score, 6) AS p95_score, n_windows,
            CAST(max_score > threshold AS INTEGER) AS is_outlier
          FROM rolled, limits ORDER BY rolled.max_score DESC, entity_id LIMIT 10""",
)
def top_entities(spark, sf):
    """The suppliers with the most unusual shipment sequences."""
    scored = checkpointed(mean_profile_scores(spark, sf))
    rolled = scoring.aggregate_entities(scored, "entity_id", prediction=None)
    threshold = thresholds.percentile(rolled, "max_score").first()["threshold"]
    flagged = scoring.classify(rolled, threshold, score="max_score")
    return rounded(scoring.top_entities(flagged, "entity_id", 10).drop("y_true"))


# --- roll-up and summaries -------------------------------------------------


@query(
    "aggregate_entities",
    f"""WITH {SCORES} SELECT entity_id, max(outlier_score) AS max_score, round(avg(outlier_score), 6) AS mean_score,
          round(median(outlier_score), 6) AS median_score, round(quantile_cont(outlier_score, 0.95), 6) AS p95_score,
          count(*) AS n_windows, coalesce(max(y_true) FILTER (y_true >= 0), -1) AS y_true,
          max(is_outlier) AS any_outlier, round(avg(is_outlier), 6) AS outlier_window_ratio
        FROM scores GROUP BY entity_id""",
)
def aggregate_entities(spark, sf):
    return rounded(scoring.aggregate_entities(scores(spark, sf), "entity_id"))


@query(
    "aggregate_entities_min_windows",
    f"""WITH {SCORES} SELECT model, entity_id, max(outlier_score) AS max_score, round(avg(outlier_score), 6) AS mean_score,
          round(median(outlier_score), 6) AS median_score, round(quantile_cont(outlier_score, 0.95), 6) AS p95_score,
          count(*) AS n_windows, coalesce(max(y_true) FILTER (y_true >= 0), -1) AS y_true
        FROM scores GROUP BY model, entity_id HAVING count(*) >= 5""",
)
def aggregate_entities_min_windows(spark, sf):
    rolled = scoring.aggregate_entities(scores(spark, sf), "entity_id", by=["model"], prediction=None, min_windows=5)
    return rounded(rolled)


@query(
    "window_score_summary",
    f"""WITH {SCORES} SELECT model, count(*) AS n_windows, count(DISTINCT entity_id) AS n_entities,
          round(avg(outlier_score), 6) AS mean_outlier_score, round(median(outlier_score), 6) AS median_outlier_score,
          round(quantile_cont(outlier_score, 0.95), 6) AS p95_outlier_score FROM scores GROUP BY model""",
)
def window_score_summary(spark, sf):
    return rounded(scoring.window_summary(scores(spark, sf), "entity_id", by=["model"]))


@query(
    "summarize_scores",
    f"""WITH {SCORES} SELECT count(*) AS n_windows, min(outlier_score) AS min_score, round(avg(outlier_score), 6) AS mean_score,
          round(median(outlier_score), 6) AS median_score, max(outlier_score) AS max_score,
          round(avg(is_outlier), 6) AS outlier_window_ratio FROM scores""",
)
def summarize_scores(spark, sf):
    return rounded(scoring.summarize(scores(spark, sf)))


@query(
    "predictions",
    f"""WITH {SCORES} SELECT window_id, entity_id, coalesce(CASE WHEN y_true >= 0 THEN y_true END, -1) AS y_true,
          outlier_score, is_outlier FROM scores""",
)
def predictions(spark, sf):
    known = scores(spark, sf).withColumn("y_true", F.when(F.col("y_true") >= 0, F.col("y_true")))
    return scoring.predictions(known, "entity_id")


@query(
    "classify",
    f"WITH {SCORES} SELECT window_id, CAST(outlier_score > 12.5 AS INTEGER) AS is_outlier FROM scores",
)
def classify(spark, sf):
    return scoring.classify(scores(spark, sf), 12.5).select("window_id", "is_outlier")


@query(
    "classify_by_model",
    f"""WITH {SCORES}, t AS (SELECT model, quantile_cont(outlier_score, 0.9) AS threshold FROM scores GROUP BY model)
        SELECT window_id, model, CAST(outlier_score > threshold AS INTEGER) AS is_outlier FROM scores JOIN t USING (model)""",
)
def classify_by_model(spark, sf):
    rows = scores(spark, sf)
    limits = thresholds.percentile(rows, "outlier_score", 90, by=["model"])
    return scoring.classify(rows, thresholds=limits).select("window_id", "model", "is_outlier")


# --- thresholds ------------------------------------------------------------


@query(
    "threshold_percentile",
    f"WITH {SCORES} SELECT round(quantile_cont(outlier_score, 0.95), 6) AS threshold FROM scores",
)
def threshold_percentile(spark, sf):
    return rounded(thresholds.percentile(scores(spark, sf), "outlier_score"))


def _best_f1_sql(rows: str) -> str:
    """Every grid point against every distinct score, per model."""
    return f"""{rows}, s AS (
      SELECT model, outlier_score AS v, sum(y_true) AS p, count(*) AS n FROM labelled GROUP BY 1, 2),
    r AS (SELECT model, min(v) AS lo, max(v) AS hi, sum(p) AS positives, sum(n) AS total FROM s GROUP BY 1),
    g AS (SELECT model, positives, i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199.0::DOUBLE) END AS t
          FROM r, range(200) AS x(i) WHERE positives > 0 AND positives < total),
    f AS (SELECT model, i, t, coalesce(sum(p) FILTER (v > t), 0) AS tp, coalesce(sum(n) FILTER (v > t), 0) AS above, any_value(positives) AS positives
          FROM g JOIN s USING (model) GROUP BY model, i, t),
    ranked AS (SELECT model, t, CAST(2 * tp AS DOUBLE) / (positives + above) AS f1 FROM f),
    best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, t) AS rn FROM ranked)
    SELECT model, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM best WHERE rn = 1
    UNION ALL SELECT model, round(quantile_cont(outlier_score, 0.95), 6), NULL FROM labelled
      GROUP BY model HAVING sum(y_true) = 0 OR sum(y_true) = count(*)"""


@query(
    "threshold_best_f1",
    "WITH "
    + _best_f1_sql(PART_SCORES + ", labelled AS (SELECT 'all' AS model, outlier_score, y_true FROM part_scores WHERE y_true >= 0)"),
)
def threshold_best_f1(spark, sf):
    found = thresholds.best_f1(part_scores(spark, sf), "outlier_score")
    return rounded(found).withColumn("model", F.lit("all"))


@query(
    "threshold_best_f1_by_model",
    "WITH " + _best_f1_sql(SCORES + ", labelled AS (SELECT model, outlier_score, y_true FROM scores WHERE y_true >= 0)"),
)
def threshold_best_f1_by_model(spark, sf):
    return rounded(thresholds.best_f1(scores(spark, sf), "outlier_score", by=["model"]))


# Only one class in the labelled rows: percentile instead of F1
@query(
    "threshold_single_class",
    f"""WITH {SCORES} SELECT model, round(quantile_cont(outlier_score, 0.95), 6) AS threshold FROM scores GROUP BY model""",
)
def threshold_single_class(spark, sf):
    normal = scores(spark, sf).withColumn("y_true", F.lit(0))
    return rounded(thresholds.select(normal, "outlier_score", by=["model"]))


@query(
    "threshold_select_percentile",
    f"WITH {SCORES} SELECT model, round(quantile_cont(outlier_score, 0.9), 6) AS threshold FROM scores GROUP BY model",
)
def threshold_select_percentile(spark, sf):
    found = thresholds.select(
        scores(spark, sf), "outlier_score", strategy=thresholds.VALIDATION_PERCENTILE, percent=90, by=["model"]
    )
    return rounded(found)



"""Small literal cases with values worked out by hand or by numpy."""

from __future__ import annotations

import numpy as np
import pytest
from checks import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlens.functions.expressions import binary_label, epoch_micros, run_order, sanitize_run_name
from trajlens.operators import compare, labels, metrics, preprocess, profile, quality, sampling, scoring, temporal, thresholds, windows
from trajlens.roles import Roles

NAN = float("nan")
ROLES = Roles()


# --- expressions -----------------------------------------------------------


def test_binary_label(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (-1,), (None,)], "v int")
    assert [r[0] for r in rows(df.select(binary_label("v")))] == [0, 1, 1, 0, None]
    text = spark.createDataFrame([("x",), ("3",)], "v string")
    assert [r[0] for r in rows(text.select(binary_label("v")))] == [None, 1]


def test_run_names(spark):
    names = ["full", "debug_100", "pilot", "debug_025", "alpha"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows(df.orderBy(run_order("n")))] == ["debug_025", "debug_100", "full", "alpha", "pilot"]
    raw = spark.createDataFrame([(" my run/1.. ",)], "n string")
    assert rows(raw.select(sanitize_run_name("n"))) == [("my_run_1",)]
    with pytest.raises(Exception, match="empty"):
        spark.createDataFrame([("..",)], "n string").select(sanitize_run_name("n")).collect()


def test_epoch_micros_ignores_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-07-01 12:34:56.789012' AS ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert rows(df.select(epoch_micros("ts"))) == [(1719837296789012,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --- quality ---------------------------------------------------------------


def test_missing_report_order_and_nan(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, NAN, "x"), (2, None, 1.0, None)], "a int, b int, c double, d string")
    expected = [("b", 2, 1.0), ("c", 1, 0.5), ("d", 1, 0.5), ("a", 0, 0.0)]
    assert rows(quality.missing_report(df)) == expected
    assert rows(quality.missing_report(df, top_n=2)) == expected[:2]
    monkeypatch.setattr(quality, "WIDE_COLUMNS", 1)
    assert rows(quality.missing_report(df)) == expected
    assert rows(quality.missing_report(df.where("false"))) == [(c, 0, 0.0) for c in "abcd"]


def test_wide_moments_equal_narrow_moments(spark, monkeypatch):
    df = spark.range(100).select(*[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(5)])
    narrow = rows(quality.numeric_moments(df, df.columns))
    monkeypatch.setattr(quality, "WIDE_COLUMNS", 2)
    wide = rows(quality.numeric_moments(df, df.columns))
    for a, b in zip(narrow, wide):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_the_two_constant_tests_differ_on_null(spark):
    df = spark.createDataFrame([(5.0, None, 7.0, None), (None, None, 7.0, NAN)], "a double, b double, c double, d double")
    assert [r[0] for r in rows(quality.constant_columns(df, nulls="value"))] == ["b", "c"]
    assert [r[0] for r in rows(quality.constant_columns(df, nulls="ignore"))] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        quality.constant_columns(df, nulls="maybe")


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (None, 1)], "a int, b int")
    assert rows(quality.duplicate_count(df)) == [(2,)]
    assert rows(quality.duplicate_count(df, ["a"])) == [(3,)]
    assert rows(quality.duplicate_count(df.where("false"))) == [(0,)]


def test_duplicates_are_compared_inside_hashes(spark, monkeypatch):
    """With hashes that all collide, only rows that are equal count."""
    df = spark.range(60).selectExpr("id % 20 AS a", "CAST(id % 3 AS STRING) AS b", "IF(id % 4 = 0, NULL, id % 2) AS c")
    expected = 60 - df.distinct().count()
    assert rows(quality.duplicate_count(df)) == [(expected,)]
    monkeypatch.setattr(quality, "row_hash", lambda columns: [F.lit(1).cast("long"), F.lit(2).cast("long")])
    assert rows(quality.duplicate_count(df)) == [(expected,)]


def test_duplicates_shuffle_hashes_only(spark, tmp_path, monkeypatch):
    wide = spark.range(50).select("id", *[F.lit("x" * 50).alias(f"c{i}") for i in range(20)])
    plans = []
    monkeypatch.setattr(quality, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.limit(0))
    quality.duplicate_count(wide)
    assert "hashpartitioning(_h1" in plans[0] and "c19" not in plans[0].split("Exchange")[0]
    assert "keys=[_h1" in plans[0].split("Exchange")[1].split("Project")[0] and "c19" not in plans[0].split("Exchange")[1].split("Project")[0]



# --- time ------------------------------------------------------------------


def test_gap_and_length_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 5), ("b", 2), ("c", 9), ("c", 9)], "e string, t int")
    assert rows(temporal.gap_report(df, "e", "t", exact=True)) == [(3, 4 / 3, 1.0, 3.0, 0.0, 3.0)]
    assert rows(temporal.length_report(df, "e", exact=True)) == [(3, 2.0, 2.0, 1.0, 3.0, 1, 3)]
    assert rows(temporal.length_report(df, "e")) == [(3, 2.0, 2.0, 1.0, 3.0, 1, 3)]
    assert rows(temporal.length_per_entity(df, "e", limit=2)) == [("a", 3), ("b", 1)]


# --- labels and sampling ---------------------------------------------------


def test_label_column_priority(spark):
    assert labels.infer_label_column(spark.createDataFrame([], "label int, class_label int")) == "class_label"
    with pytest.raises(ValueError, match="no label column"):
        labels.infer_label_column(spark.createDataFrame([], "x int"))


def test_labels_attach_and_default(spark):
    known = spark.createDataFrame([(1, 0), (1, 3), (2, 0), (3, None), (4, -2)], "vehicle_id int, class_label int")
    readouts = spark.createDataFrame([(i,) for i in range(1, 6)], "vehicle_id int")
    attached = labels.attach_labels(readouts, known, "vehicle_id")
    assert rows(attached, "vehicle_id") == [(1, 1), (2, 0), (3, -1), (4, 0), (5, -1)]
    assert rows(labels.label_summary(known, "vehicle_id")) == [(3, 2, 1, 1 / 3, "class_label")]


def test_keep_normal_needs_the_column_and_makes_no_duplicates(spark):
    tte = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "vehicle_id int, in_study_repair int")
    df = spark.createDataFrame([(1,), (2,), (3,)], "vehicle_id int")
    assert rows(labels.keep_normal(df, tte, "vehicle_id")) == [(1,)]
    with pytest.raises(ValueError):
        sampling.normal_entities(tte.drop("in_study_repair"), "vehicle_id", 2)


@pytest.mark.parametrize(
    "n,positives,negatives,expected",
    [(25, 5, 95, (2, 23)), (25, 50, 50, (12, 13)), (5, 1, 99, (1, 4)), (1, 5, 5, (0, 1)), (10, 0, 3, (0, 3)), (10, 20, 0, (9, 0))],
)
def test_class_sizes(n, positives, negatives, expected):
    assert sampling._class_sizes(n, positives, negatives, 2) == expected


def test_stratified_entities_takes_lowest_ids(spark):
    known = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(40)], "vehicle_id int, class_label int")
    assert rows(sampling.stratified_entities(known, "vehicle_id", 8), "vehicle_id") == [
        (0,), (1,), (2,), (3,), (4,), (5,), (6,), (7,)
    ]
    assert sampling.stratified_entities(known, "vehicle_id", None).count() == 40


def test_bounded_sample_depends_on_keys_alone(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    drawn = lambda d, **o: rows(sampling.bounded_sample(d, ["v"], ["id"], **o).select("id"), "id")
    half = drawn(df, fraction=0.5, max_rows=1000)
    assert 400 < len(half) < 600 and half == drawn(df.repartition(7, "v"), fraction=0.5, max_rows=1000)
    assert set(drawn(df, fraction=0.5, max_rows=50)) < set(half) and len(drawn(df, fraction=0.5, max_rows=50)) == 50
    assert drawn(df, fraction=0.5, seed=1) != half and drawn(df, fraction=0.0) == []


def test_class_sizes_round_the_share(spark):
    known = spark.createDataFrame([(i, int(i < 69)) for i in range(120)], "vehicle_id int, class_label int")
    chosen = sampling.stratified_entities(known, "vehicle_id", 100)
    assert chosen.where("vehicle_id < 69").count() == round(100 * (69 / 120)) == 57
    assert sampling.stratified_entities(known.limit(0), "vehicle_id", 5).count() == 0


# --- preprocessing ---------------------------------------------------------


def test_numeric_columns_by_type(spark):
    df = spark.createDataFrame([], "a tinyint, b smallint, c decimal(9,2), d interval day, e string, f float, y_true int")
    assert preprocess.numeric_columns(df, ROLES.non_features) == ["a", "b", "c", "f"]
    assert preprocess.numeric_columns(df, ["a"], limit=2) == ["b", "c"]


def _train(spark):
    data = [(1, 1, 1.0, NAN, 5.0, None, 1), (1, 2, 2.0, 4.0, 5.0, None, 2), (2, 1, None, 8.0, 5.0, None, 3), (2, 2, 9.0, 6.0, 5.0, 1.0, 4)]
    return spark.createDataFrame(data, "vehicle_id int, time_step int, a double, b double, c double, d double, e int")


def test_fit_and_apply(spark):
    train = _train(spark)
    fitted = preprocess.fit(train, max_missing_ratio=0.7)
    assert fitted.source_columns == ["a", "b", "e"]
    assert sorted(fitted.dropped) == [("c", "constant"), ("d", "constant"), ("d", "missing_ratio")]
    filled = {"a": [1, 2, 2, 9], "b": [6, 4, 8, 6], "e": [1, 2, 3, 4]}
    for f in fitted.features:
        assert f.mean == pytest.approx(np.mean(filled[f.feature]))
        assert f.std == pytest.approx(np.std(filled[f.feature]))
    scaled = preprocess.apply(train, fitted)
    assert scaled.columns == ["vehicle_id", "time_step", "x_0", "x_1", "x_2"]
    assert dict(scaled.dtypes)["x_0"] == "float"
    for name, source in zip(fitted.scaled_columns, fitted.source_columns):
        expected = (np.array(filled[source]) - np.mean(filled[source])) / np.std(filled[source])
        got = [r[0] for r in rows(scaled.orderBy("vehicle_id", "time_step").select(name))]
        assert got == pytest.approx(expected.astype(np.float32))
    again = preprocess.FittedPreprocessing.from_parameters(fitted.parameters(spark))
    assert again.features == fitted.features
    assert rows(preprocess.apply(train, fitted.parameters(spark))) == rows(scaled)


def test_missing_ratio_limit_is_strict(spark):
    fitted = preprocess.fit(_train(spark), features=["d", "a"], max_missing_ratio=0.75, drop_constant=False)
    assert fitted.source_columns == ["d", "a"]


def test_fill_strategies(spark):
    train = _train(spark).withColumn("z", F.lit(None).cast("double"))
    def fills(strategy):
        return dict(rows(preprocess.fit_imputation(train, ["a", "z"], strategy)))
    assert fills("median") == {"a": 2.0, "z": 0.0}
    assert fills("mean") == {"a": 4.0, "z": 0.0}
    assert fills("zero") == {"a": 0.0, "z": 0.0}
    with pytest.raises(ValueError, match="unsupported"):
        fills("mode")
    assert dict(rows(preprocess.fit_imputation(train, ["a", "z"], relative_error=0.05))) == {"a": 2.0, "z": 0.0}
    assert rows(preprocess.fit_scaling(train, ["z"], {"z": 3.0})) == [("z", 3.0, 1.0)]


def test_parameters_come_from_train_only(spark):
    train = _train(spark)
    before = preprocess.fit(train).features
    other = train.withColumn("a", F.col("a") * 1000)
    preprocess.apply(other, preprocess.fit(train)).collect()
    assert preprocess.fit(train).features == before


# --- windows ---------------------------------------------------------------


def _two(spark):
    data = [("A", t, t - 1, t + 9, 1) for t in range(1, 6)] + [("B", t, t + 4, t + 14, 0) for t in range(1, 6)]
    return spark.createDataFrame(data, "vehicle_id string, time_step int, f1 int, f2 int, y_true int")


def test_windows_of_two_entities(spark):
    built = windows.build_windows(_two(spark), ["f1", "f2"], "vehicle_id", "time_step", "y_true", size=3, stride=2)
    found = rows(built, "window_id")
    assert [(r[0], r[2], r[3], r[4], r[6]) for r in found] == [
        ("A_0", 0, 1, 3, 1), ("A_2", 2, 3, 5, 1), ("B_0", 0, 1, 3, 0), ("B_2", 2, 3, 5, 0)
    ]
    assert found[1][5] == [[2.0, 12.0], [3.0, 13.0], [4.0, 14.0]]
    assert built.schema["X"].dataType == T.ArrayType(T.ArrayType(T.FloatType(), True), False) or "float" in str(built.schema["X"].dataType).lower()


def test_window_label_is_the_largest(spark):
    data = [("A", t, 0.0, y) for t, y in zip(range(1, 6), [0, 0, 1, 0, 0])]
    df = spark.createDataFrame(data, "vehicle_id string, time_step int, f double, y_true int")
    def found(policy, label="y_true"):
        built = windows.build_windows(df, ["f"], "vehicle_id", "time_step", label, 3, 2, policy)
        return [r[0] for r in rows(built.orderBy("window_id").select("y_true"))]
    assert found("max_label_in_window") == [1, 1]
    assert found("unlabeled") == [-1, -1]
    assert found("vehicle_label", None) == [-1, -1]
    with pytest.raises(ValueError, match="label_policy"):
        found("first")


def test_window_limits(spark):
    df = _two(spark)
    assert windows.build_windows(df, ["f1"], "vehicle_id", "time_step", size=6, stride=1).isEmpty()
    with pytest.raises(ValueError, match="feature"):
        windows.build_windows(df, [], "vehicle_id", "time_step")
    nulls = df.withColumn("vehicle_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="null in vehicle_id"):
        windows.build_windows(nulls, ["f1"], "vehicle_id", "time_step", size=2).collect()


def test_window_count_per_entity(spark):
    df = spark.range(57).select(F.lit(1).alias("vehicle_id"), F.col("id").alias("time_step"), F.col("id").alias("f"))
    assert windows.build_windows(df, ["f"], "vehicle_id", "time_step", size=30, stride=5).count() == (57 - 30) // 5 + 1


def test_written_windows(spark, tmp_path):
    built = windows.build_windows(_two(spark), ["f1", "f2"], "vehicle_id", "time_step", "y_true", 3, 2)
    path = str(tmp_path / "windows")
    summary = windows.write_windows(built, path, "vehicle_id", files=2, features=["f1", "f2"]).first().asDict()
    assert summary == {"n_windows": 4, "n_entities": 2, "window_size": 3, "n_features": 2, "output_path": path}
    assert rows(windows.read_windows(spark, path), "window_id") == rows(built, "window_id")
    assert windows.read_windows(spark, path, ["X"]).columns == ["X"]
    assert windows.read_feature_names(spark, path) == ["f1", "f2"]
    assert windows.read_windows(spark, path).schema["X"].dataType.simpleString() == "array<array<float>>"
    expected = windows.window_schema("vehicle_id", T.StringType(), T.IntegerType())
    assert windows.read_windows(spark, path).schema.simpleString() == expected.simpleString()


# --- scores and thresholds -------------------------------------------------


def test_roll_up_and_classify(spark):
    data = [("A", 0.1, 1, 0), ("A", 0.9, 1, 1), ("B", 0.2, 0, 0), ("B", 0.3, 0, 0), ("C", 0.5, -1, 0)]
    scored = spark.createDataFrame(data, "vehicle_id string, outlier_score double, y_true int, is_outlier int")
    rolled = scoring.aggregate_entities(scored, "vehicle_id").orderBy("vehicle_id")
    a, b, c = rolled.collect()
    assert (a["max_score"], a["y_true"], a["any_outlier"], a["outlier_window_ratio"]) == (0.9, 1, 1, 0.5)
    assert a["median_score"] == 0.5 and a["p95_score"] == pytest.approx(np.percentile([0.1, 0.9], 95))
    assert b["y_true"] == 0 and c["y_true"] == -1 and c["n_windows"] == 1
    flagged = scoring.classify(rolled, 0.5, score="max_score")
    assert [r["is_outlier"] for r in flagged.orderBy("vehicle_id").collect()] == [1, 0, 0]
    assert rows(scoring.aggregate_entities(scored, "vehicle_id", min_windows=2).select("vehicle_id"), "vehicle_id") == [("A",), ("B",)]
    unflagged = scoring.aggregate_entities(scored.drop("is_outlier"), "vehicle_id")
    assert rows(unflagged.select("any_outlier", "outlier_window_ratio").distinct()) == [(0, 0.0)]
    with pytest.raises(ValueError):
        scoring.classify(scored)


def test_prediction_rows(spark):
    scored = spark.createDataFrame([("w", "A", 0.5, None)], "window_id string, vehicle_id string, outlier_score double, y_true int")
    found = scoring.predictions(scored, "vehicle_id")
    assert found.columns == ["window_id", "vehicle_id", "y_true", "outlier_score"]
    assert rows(found) == [("w", "A", -1, 0.5)]


def test_percentile_threshold(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (10.0,)], "s double")
    found = thresholds.percentile(df, "s", 75).first()["threshold"]
    assert found == pytest.approx(np.percentile([0.1, 0.2, 0.3, 10.0], 75)) and found > 0.3
    assert [r["is_outlier"] for r in scoring.classify(df, found, score="s").orderBy("s").collect()] == [0, 0, 0, 1]
    with pytest.raises(Exception, match="no scores"):
        thresholds.percentile(df.where("false"), "s").collect()


def _grid_f1(y, s, points=200):
    grid = np.linspace(s.min(), s.max(), points)
    f1 = []
    for t in grid:
        p = s > t
        f1.append(2 * (p & (y == 1)).sum() / max((y == 1).sum() + p.sum(), 1))
    return grid[int(np.argmax(f1))]


@pytest.mark.parametrize("seed", range(6))
def test_best_f1_is_the_first_best_grid_point(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 80)
    s = np.round(rng.normal(size=80) + y * rng.uniform(0, 2), int(rng.integers(0, 4)))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)] + [(99.0, -1)], "s double, y_true int")
    assert thresholds.best_f1(df, "s").first()["threshold"] == _grid_f1(y, s)


def test_best_f1_special_cases(spark):
    easy = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "s double, y_true int")
    assert 0.2 <= thresholds.best_f1(easy, "s").first()["threshold"] < 0.8
    flat = spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, y_true int")
    assert rows(thresholds.best_f1(flat, "s")) == [(0.5, 0.0)]
    single = spark.createDataFrame([(1.0, 0), (2.0, 0)], "s double, y_true int")
    assert rows(thresholds.best_f1(single, "s")) == [(pytest.approx(1.95), None)]
    with pytest.raises(Exception, match="no labelled scores"):
        thresholds.best_f1(easy.where("y_true > 5"), "s").collect()
    with pytest.raises(ValueError, match="unknown"):
        thresholds.select(easy, "s", strategy="guess")
    with pytest.raises(ValueError, match="label"):
        thresholds.select(easy.drop("y_true"), "s")


# --- metrics ---------------------------------------------------------------


def test_metrics_ignore_unlabelled_rows(spark):
    data = [(0, 0, 0.1), (1, 1, 0.9), (1, 0, 0.4), (-1, 1, 0.8)]
    df = spark.createDataFrame(data, "y_true int, is_outlier int, s double")
    m = metrics.binary_metrics(df).first()
    assert (m["n_samples"], m["precision"], m["recall"]) == (3, 1.0, 0.5) and m["f1_score"] == pytest.approx(2 / 3)
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 0, 1, 1)
    assert rows(metrics.ranking_metrics(df, "s")) == [(1.0, 1.0)]


def test_metrics_with_one_class_or_none(spark):
    df = spark.createDataFrame([(0, 1, 0.1), (0, 0, 0.3)], "y_true int, is_outlier int, s double")
    m = metrics.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1_score"], m["tp"]) == (0.0, 0.0, 0.0, None)
    assert rows(metrics.ranking_metrics(df, "s")) == [(None, None)]
    assert metrics.pr_curve(df, "s").isEmpty() and metrics.roc_curve(df, "s").isEmpty()
    empty = metrics.binary_metrics(df.where("false")).first()
    assert (empty["n_samples"], empty["precision"], empty["f1_score"]) == (0, None, None)
    assert rows(metrics.confusion_matrix(df), "y_true", "y_pred") == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)]


def test_ranking_known_values(spark):
    """Scores .1 .4 .35 .8 with labels 0 0 1 1: AUC 0.75, average precision 0.8333."""
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y_true int")
    auc, ap = rows(metrics.ranking_metrics(df, "s"))[0]
    assert auc == 0.75 and ap == pytest.approx(5 / 6)
    negated = df.withColumn("s", -F.col("s"))
    assert rows(metrics.roc_auc(negated, "s"))[0][0] == 0.25
    assert rows(metrics.pr_curve(df, "s").orderBy(F.asc_nulls_last("threshold"))) == [
        (0.1, 0.5, 1.0), (0.35, pytest.approx(2 / 3), 1.0), (0.4, 0.5, 0.5), (0.8, 1.0, 0.5), (None, 1.0, 0.0)
    ]
    assert rows(metrics.roc_curve(df, "s").orderBy(F.desc("threshold"))) == [
        (float("inf"), 0.0, 0.0), (0.8, 0.0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1.0), (0.1, 1.0, 1.0)
    ]


def test_auc_counts_ties_as_half(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)] + [(NAN, 1)], "s double, y_true int")
    p, q = s[y == 1][:, None], s[y == 0][None, :]
    assert rows(metrics.roc_auc(df, "s"))[0][0] == pytest.approx(((p > q).sum() + 0.5 * (p == q).sum()) / (p.size * q.size))


# --- distributions ---------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_histogram_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=300) * 10 ** int(seed), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(NAN,), (None,), (float("inf"),)], "v double")
    counts, edges = np.histogram(values, 30)
    found = rows(profile.histogram(df, ["v"]), "bin")
    assert [r[4] for r in found] == list(counts)
    assert [r[2] for r in found] == pytest.approx(edges[:-1]) and [r[3] for r in found] == pytest.approx(edges[1:])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    found = rows(profile.histogram(df, ["v"]), "bin")
    counts, edges = np.histogram([3.0, 3.0], 30)
    assert [r[4] for r in found] == list(counts) and found[0][2] == 2.5 and found[-1][3] == 3.5


def test_boxplot_leaves_out_fliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    q1, q2, q3 = np.percentile([1, 2, 3, 4, 5, 100], [25, 50, 75])
    assert rows(profile.boxplot_stats(df, ["v"])) == [("v", q1, q2, q3, 1.0, 5.0, 6)]


def test_correlation_rules(spark):
    data = [(1.0, 2.0, 5.0, None), (2.0, NAN, 5.0, 1.0), (3.0, 7.0, 5.0, 2.0), (4.0, 8.0, 5.0, None)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    found = {(r[0], r[1]): r[2] for r in rows(profile.correlation(df, ["a", "b", "c", "d"]))}
    assert set(found) == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}  # c is constant, d has two values
    assert found[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 7, 7, 8])[0, 1])
    assert profile.correlation(df, ["c", "a"]).isEmpty()


# --- comparison ------------------------------------------------------------


def _study(spark):
    data = [
        ("full", "lstm", 0.70, 0.68), ("full", "transformer", 0.80, 0.75),
        ("debug_025", "lstm", 0.55, 0.50), ("debug_025", "transformer", 0.65, 0.60),
        ("extra", "b", None, None), ("extra", "a", None, 0.1),
    ]
    return spark.createDataFrame(data, "run_name string, model string, pr_auc double, f1_score double")


def test_study_summary(spark):
    found = rows(compare.study_summary(_study(spark)))
    assert [(r[0], r[1], r[2]) for r in found] == [("debug_025", 25, "transformer"), ("full", None, "transformer"), ("extra", None, "a")]
    assert [r[1] for r in rows(compare.ordered_runs(_study(spark)), "position")] == ["debug_025", "full", "extra"]


def test_comparison_needs_all_models(spark):
    full = _study(spark).where("run_name = 'full'")
    expected = spark.createDataFrame([("lstm",), ("transformer",), ("cnn",)], "model string")
    with pytest.raises(RuntimeError, match="cnn"):
        compare.run_comparison(full, expected)
    flagged = compare.run_comparison(full, expected, allow_partial=True)
    assert rows(flagged.select("model", "best_by_pr_auc", "best_by_f1"), "model") == [("lstm", False, False), ("transformer", True, True)]
    assert [r[0] for r in rows(compare.ranked(full).select("model"))] == ["transformer", "lstm"]


def test_metric_by_run_order_and_gaps(spark):
    found = compare.metric_by_run(_study(spark), "f1_score", ["lstm", "transformer", "a"])
    assert rows(found) == [("debug_025", 0.5, 0.6, None), ("full", 0.68, 0.75, None), ("extra", None, None, 0.1)]

"""Large groups: results must not depend on where the size limit lies."""

from __future__ import annotations

import numpy as np
import pytest
from checks import rows
from pyspark.sql import functions as F

from trajlens.operators import metrics, ordering, quantiles, scoring, temporal, thresholds, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """One entity holds more than a third of the rows; times and whole rows repeat."""
    return spark.range(0, 3000, 1, 7).select(
        F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(1 + F.col("id") % 17).alias("entity"),
        F.floor(F.pmod(F.xxhash64("id"), F.lit(700)) / 2).alias("t"),
        F.when(F.col("id") % 11 != 0, (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))).cast("double")).alias("f"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)).cast("int").alias("y"),
    ).checkpoint()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(a.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_large_groups_lists_only_groups_above_the_limit(skewed):
    found = ordering.large_groups(skewed, ["entity"], 500)
    assert rows(found) == [(0, 1200)]
    assert ordering.large_groups(skewed, ["entity"], 1200) is None
    assert ordering.large_groups(skewed, ["entity"], None) is None


def test_percentiles_of_many_large_groups(spark, monkeypatch):
    """20,000 groups above the limit: their ranks are found as tables, whatever their number."""
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 4)
    monkeypatch.setattr(quantiles, "PROBES", 4)
    df = spark.range(160_000).selectExpr("id % 20000 AS g", "pmod(xxhash64(id), 1000) / 8.0D AS v")
    fractions = {"low": 0.1, "median": 0.5, "high": 0.95}
    found = quantiles.exact_percentiles(df, ["g"], "v", fractions, max_group_rows=6)
    expected = df.groupBy("g").agg(*[F.percentile("v", f).alias(name) for name, f in fractions.items()])
    both = found.join(expected.withColumnsRenamed({n: f"{n}_" for n in fractions}), "g")
    wrong = [f"abs({n} - {n}_) > 1e-9" for n in fractions]
    assert found.count() == 20_000 and both.where(" OR ".join(wrong)).isEmpty()


def evaluations(spark, make):
    """How often each input row is evaluated in computing a result."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).selectExpr(
        "id % 5 AS e", "CAST(id % 2 AS INT) AS y_true", "(id % 97) / 97.0D AS s", "CAST(id % 3 = 0 AS INT) AS is_outlier"
    )
    make(rows.mapInArrow(count, rows.schema)).collect()
    return seen.value / 1000


@pytest.mark.parametrize("limit", [50, 10**6])
def test_inputs_are_evaluated_once(spark, limit):
    from trajlens.operators import metrics, scoring

    for make in (
        lambda df: metrics.ranking_metrics(df, "s", by=["e"], max_group_rows=limit),
        lambda df: metrics.pr_curve(df, "s", max_group_rows=limit),
        lambda df: metrics.roc_curve(df, "s", by=["e"], drop_collinear=True, max_group_rows=limit),
        lambda df: scoring.aggregate_entities(df, "e", score="s", max_group_rows=limit),
        lambda df: scoring.window_summary(df, "e", score="s", max_group_rows=limit),
        lambda df: scoring.summarize(df, ["e"], score="s", max_group_rows=limit),
    ):
        assert evaluations(spark, make) == 1


@pytest.mark.parametrize("limit", [50, 10**6])
def test_correlation_evaluates_its_input_once(spark, limit):
    """Also where a column misses values, which are filled by the median of the others."""
    from trajlens.operators import profile

    for hole in ("false", "s > 0.5"):
        holed = f"IF({hole}, NULL, s) AS s"
        assert evaluations(spark, lambda df: profile.correlation(df.selectExpr("e", holed), ["e", "s"], limit)) == 1


@pytest.mark.parametrize("direct,probes", [(4, 4), (30, 8), (50_000, 500)])
def test_ranks_of_several_columns(spark, monkeypatch, direct, probes):
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", direct)
    monkeypatch.setattr(quantiles, "PROBES", probes)
    df = spark.range(2000).selectExpr("pmod(xxhash64(id), 100000) / 8 - 4000 AS a", "IF(id % 3 = 0, NULL, id % 7 - 3.0D) AS b").checkpoint()
    ranks = [0, 1, 499, 500, 998, 999, 1000, 1332, 1333, 1999, 2000, -1]
    found = quantiles.column_ranks(df, {c: (F.col(c), df.where(f"{c} IS NOT NULL").count(), ranks) for c in df.columns})
    for c in df.columns:
        ordered = sorted(r[0] for r in rows(df.where(f"{c} IS NOT NULL").select(c)))
        assert found[c] == {r: ordered[r] for r in ranks if 0 <= r < len(ordered)}


def test_reports_of_whole_columns_store_no_cells(spark, monkeypatch):
    """Their passes read the rows of a plain table as they are; ranks are narrowed, and looked up once for all reports."""
    from trajlens.operators import profile

    def refuse(df):
        raise AssertionError(f"stored {df.columns}")

    asked, ranks = [], profile.column_ranks
    monkeypatch.setattr(profile, "column_ranks", lambda df, wanted: asked.append(wanted) or ranks(df, wanted))
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 20)
    monkeypatch.setattr(quantiles, "PROBES", 8)
    df = spark.range(3000).selectExpr(
        "pmod(xxhash64(id), 1000) / 8.0D AS a", "IF(id % 5 = 0, NULL, pow(pmod(xxhash64(id, 1), 50), 2)) AS b",
        "IF(id % 5 = 0, double('NaN'), id % 11) AS c", "CAST(NULL AS double) AS d", "named_struct('x', id % 4) AS s",
    ).checkpoint()
    for module in (ordering, quantiles):
        monkeypatch.setattr(module, "settled", refuse)
    names = ["a", "b", "c", "d", "s.x"]
    known = profile.Columns(df, names)
    boxes = {r["feature"]: r for r in profile.boxplot_stats(df, names, known=known).collect()}
    bins, pairs = profile.histogram(df, names, known=known).collect(), profile.correlation(df, names, known=known).collect()
    assert set(boxes) == {r["feature"] for r in bins} == {r["feature_a"] for r in pairs} == {"a", "b", "c", "s.x"}
    filled = {}
    for name, box in boxes.items():
        cells = np.array([np.nan if r[0] is None else r[0] for r in df.select(name).collect()], dtype=float)
        values = cells[np.isfinite(cells)]
        q1, median, q3 = np.percentile(values, [25, 50, 75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert tuple(box)[1:] == pytest.approx((q1, median, q3, min(inside.min(), q1), max(inside.max(), q3), values.size))
        counts, edges = np.histogram(values, 30)
        own = sorted((r for r in bins if r["feature"] == name), key=lambda r: r["bin"])
        assert [r["low"] for r in own] == pytest.approx(edges[:-1]) and [r["count"] for r in own] == list(counts)
        filled[name] = np.where(np.isfinite(cells), cells, median)
    for r in pairs:
        assert r["correlation"] == pytest.approx(np.corrcoef(filled[r["feature_a"]], filled[r["feature_b"]])[0, 1], abs=1e-9)
    assert not any(ranks for wanted in asked[1:] for _, _, ranks in wanted.values())


def test_reports_of_gaps_and_lengths_store_their_value_alone(spark, monkeypatch, skewed):
    stored, settled = [], ordering.settled
    monkeypatch.setattr(ordering, "settled", lambda df: stored.append(df.columns) or settled(df))
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 20)
    limits = [
        (temporal.gap_report(skewed, "entity", "t", exact=True, max_group_rows=n), temporal.length_report(skewed, "entity", exact=True, max_group_rows=m))
        for n, m in ((None, None), (2500, 5))
    ]
    assert {tuple(c) for c in stored} == {("gap",), ("n_records",)}
    for plain, narrowed in zip(*limits):
        assert plain.schema.simpleString() == narrowed.schema.simpleString() and rows(plain) == rows(narrowed)


@pytest.mark.parametrize("slice_rows", [50, 400, 5000])
def test_positions(skewed, slice_rows):
    order = ["t", "f", "y"]
    plain = ordering.with_position(skewed, ["entity"], order)
    groups = ordering.large_groups(skewed, ["entity"], 100)
    same(plain, ordering.with_position(skewed, ["entity"], order, groups=groups, slice_rows=slice_rows))


def test_running_totals(skewed):
    distinct = skewed.groupBy("entity", "t").agg(F.count(F.lit(1)).alias("n"))
    plain = ordering.running_totals(distinct, ["entity"], ["t"], {"total": "n"}, None)
    same(plain, ordering.running_totals(distinct, ["entity"], ["t"], {"total": "n"}, 100, slice_rows=30))


def test_running_totals_without_keys(skewed):
    distinct = skewed.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    plain = ordering.running_totals(distinct, [], ["t"], {"total": "n"}, None)
    same(plain, ordering.running_totals(distinct, [], ["t"], {"total": "n"}, 100, slice_rows=40))


def test_chunks_borrow_neighbours(spark):
    df = spark.range(10).select(F.col("id").alias("_idx"))
    placed = ordering.in_chunks(df, 4, before=1, after=2)
    by_chunk = {}
    for idx, chunk, own in rows(placed, "_chunk", "_idx"):
        by_chunk.setdefault(chunk, []).append((idx, own))
    assert [i for i, own in by_chunk[0] if own] == [0, 1, 2, 3]
    assert [i for i, own in by_chunk[0] if not own] == [4, 5]
    assert [i for i, own in by_chunk[1] if not own] == [3, 8, 9]
    with pytest.raises(ValueError):
        ordering.in_chunks(df, 2, after=3)


@pytest.mark.parametrize("label", [None, "y"])
@pytest.mark.parametrize("size,stride,chunk", [(30, 5, 60), (7, 3, 10), (4, 6, 20), (1, 1, 5)])
def test_windows_do_not_depend_on_the_limit(skewed, size, stride, chunk, label):
    args = dict(label=label, size=size, stride=stride, label_policy="max_label_in_window")
    plain = windows.build_windows(skewed, ["f"], "entity", "t", max_group_rows=None, **args)
    same(plain, windows.build_windows(skewed, ["f"], "entity", "t", max_group_rows=100, chunk_rows=chunk, **args))


def test_windows_match_sorted_slices(skewed):
    """Brute force over the collected rows."""
    built = windows.build_windows(skewed, ["f"], "entity", "t", "y", size=9, stride=4, max_group_rows=100, dtype="double")
    by_entity: dict[int, list] = {}
    for entity, t, f, y in rows(skewed):
        by_entity.setdefault(entity, []).append((t, f is not None, f or 0.0, y))
    expected = {}
    for entity, steps in by_entity.items():
        steps.sort()
        for start in range(0, len(steps) - 9 + 1, 4):
            part = steps[start : start + 9]
            values = [[s[2] if s[1] else None] for s in part]
            expected[f"{entity}_{start}"] = (part[0][0], part[-1][0], values, max(s[3] for s in part))
    found = {r["window_id"]: (r["start_time_step"], r["end_time_step"], r["X"], r["y_true"]) for r in built.collect()}
    assert found == expected


def test_trajectory_parts(skewed):
    plain = windows.trajectories(skewed, ["f"], "entity", "t", "y", part_rows=200)
    same(plain, windows.trajectories(skewed, ["f"], "entity", "t", "y", part_rows=200, max_group_rows=100))
    parts = rows(plain.where("entity = 0").select("part", "n_steps"), "part")
    assert parts == [(i, 200) for i in range(6)]


def test_gaps(skewed):
    plain = temporal.gaps(skewed, "entity", "t", max_group_rows=None)
    same(plain, temporal.gaps(skewed, "entity", "t", max_group_rows=100, chunk_rows=37))


@pytest.mark.parametrize("discrete", [False, True])
@pytest.mark.parametrize("store", [False, True])
def test_percentiles(skewed, monkeypatch, discrete, store):
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 10)
    monkeypatch.setattr(quantiles, "PROBES", 20)
    values = skewed.withColumn("v", F.col("t") + F.col("f") / 7)
    fractions = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = quantiles.exact_percentiles(values, ["entity"], "v", fractions, discrete, 100, store)
    method = "inverted_cdf" if discrete else "linear"
    for row in found.collect():
        data = [r["v"] for r in values.where(F.col("entity") == row["entity"]).collect() if r["v"] is not None]
        for name, fraction in fractions.items():
            assert row[name] == pytest.approx(np.percentile(data, fraction * 100, method=method), rel=1e-12)


def test_percentiles_of_few_distinct_values(skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 10)
    fractions = {"q1": 0.25, "q3": 0.75}
    found = quantiles.exact_percentiles(skewed, [], "f", fractions, max_group_rows=100)
    data = [r["f"] for r in skewed.collect() if r["f"] is not None]
    assert rows(found) == [(np.percentile(data, 25), np.percentile(data, 75))]


def test_percentiles_of_nothing(skewed):
    empty = quantiles.exact_percentiles(skewed.where("false"), [], "f", {"m": 0.5})
    assert rows(empty) == [(None,)]
    assert quantiles.exact_percentiles(skewed.where("false"), ["entity"], "f", {"m": 0.5}).isEmpty()


def test_roll_up_and_metrics_do_not_depend_on_the_limit(skewed):
    scored = skewed.select("entity", (F.col("t") + F.col("f") / 7).alias("outlier_score"), F.col("y").alias("y_true")).where(
        "outlier_score is not null"
    )
    same(
        scoring.aggregate_entities(scored, "entity", max_group_rows=None).drop("mean_score"),
        scoring.aggregate_entities(scored, "entity", max_group_rows=100).drop("mean_score"),
    )
    for curve in (metrics.pr_curve, metrics.roc_curve):
        same(curve(scored, "outlier_score", max_group_rows=None), curve(scored, "outlier_score", max_group_rows=50))
        same(
            curve(scored, "outlier_score", by=["entity"], max_group_rows=None),
            curve(scored, "outlier_score", by=["entity"], max_group_rows=50),
        )
    same(
        metrics.roc_curve(scored, "outlier_score", drop_collinear=True, max_group_rows=None),
        metrics.roc_curve(scored, "outlier_score", drop_collinear=True, max_group_rows=50),
    )
    a = metrics.ranking_metrics(scored, "outlier_score", max_group_rows=None).first()
    b = metrics.ranking_metrics(scored, "outlier_score", max_group_rows=50).first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"], rel=1e-12) and a["pr_auc"] == pytest.approx(b["pr_auc"], rel=1e-12)
    same(
        thresholds.percentile(scored, "outlier_score", 95),
        thresholds.percentile(scored, "outlier_score", 95, max_group_rows=50),
    )


def test_medians_of_long_columns_shuffle_no_cells(spark, monkeypatch):
    """The fit's medians of long columns come from passes over whole rows; ties, holes, infinities and few values included."""
    from trajlens.operators import preprocess, quantiles

    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 20)
    monkeypatch.setattr(quantiles, "PROBES", 10)
    columns = ["a", "b", "c", "d"]
    df = spark.range(4001).selectExpr(
        "sin(id) AS a", "CAST(id % 3 AS DOUBLE) AS b", "IF(id % 4 = 0, NULL, IF(id % 7 = 0, double('NaN'), id * 1.5)) AS c",
        "IF(id % 5 < 2, double('-Infinity'), cos(id)) AS d",
    )
    expected = preprocess.medians(df, columns, max_group_rows=None)
    monkeypatch.setattr(preprocess, "exact_percentiles", lambda *a, **k: pytest.fail("cells were exploded"))
    found = preprocess.fit(df, columns, max_group_rows=100)
    assert {f.feature: f.imputation_value for f in found.features} == {c: v or 0.0 for c, v in expected.items()}

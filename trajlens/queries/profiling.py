"""Queries over raw tables: quality, time, labels, sampling, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions.expressions import binary_label, safe_numeric
from trajlens.operators import labels, lineage, preprocess, profile, quality, sampling, temporal
from trajlens.plans import profile as profile_tables
from trajlens.queries.bindings import (
    CELLS,
    CLASSES,
    CLEAN,
    FEATURES,
    ORDER_CLASSES,
    READOUTS,
    REPAIRS,
    ROLES,
    SCORES,
    classes,
    order_classes,
    readouts,
    repairs,
    rounded,
    scores,
    table,
)
from trajlens.queries.registry import query
from trajlens.sources.tables import TableSet

# --- quality ---------------------------------------------------------------


@query("shape", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def shape(spark, sf):
    return quality.shape(table(spark, sf, "lineitem"))


@query(
    "duplicate_rows",
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (
         SELECT count(*) AS n FROM events GROUP BY user_id, event_type, value)""",
)
def duplicate_rows(spark, sf):
    return quality.duplicate_count(table(spark, sf, "events").select("user_id", "event_type", "value"))


@query(
    "duplicate_count",
    f"""WITH {READOUTS} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (
         SELECT count(*) AS n FROM readouts GROUP BY entity_id, t)""",
)
def duplicate_count(spark, sf):
    return quality.duplicate_count(readouts(spark, sf), ["entity_id", "t"])


_MISSING = f"""WITH {READOUTS}, counted AS (
  SELECT count(*) AS n, count(*) - count(entity_id) AS c0, count(*) - count(t) AS c1, count(*) - count(quantity) AS c2,
         count(*) - count(price) AS c3, count(*) - count(discount) AS c4,
         count(*) FILTER (tax IS NULL OR isnan(tax)) AS c5, count(*) - count(unit) AS c6, count(*) - count(blank) AS c7
  FROM readouts), report AS (
  SELECT 0 AS ordinal, 'entity_id' AS "column", c0 AS missing_count, c0 / n AS missing_ratio FROM counted
  UNION ALL SELECT 1, 't', c1, c1 / n FROM counted UNION ALL SELECT 2, 'quantity', c2, c2 / n FROM counted
  UNION ALL SELECT 3, 'price', c3, c3 / n FROM counted UNION ALL SELECT 4, 'discount', c4, c4 / n FROM counted
  UNION ALL SELECT 5, 'tax', c5, c5 / n FROM counted UNION ALL SELECT 6, 'unit', c6, c6 / n FROM counted
  UNION ALL SELECT 7, 'blank', c7, c7 / n FROM counted)"""


@query("missing_report", _MISSING + ' SELECT "column", missing_count, missing_ratio FROM report')
def missing_report(spark, sf):
    return quality.missing_report(readouts(spark, sf))


@query(
    "missing_report_top",
    _MISSING + ' SELECT "column", missing_count, missing_ratio FROM report ORDER BY missing_ratio DESC, ordinal LIMIT 4',
)
def missing_report_top(spark, sf):
    return quality.missing_report(readouts(spark, sf), top_n=4)


@query(
    "column_profile",
    _MISSING
    + """ SELECT ordinal, "column", CASE "column" WHEN 'entity_id' THEN 'bigint' WHEN 't' THEN 'bigint'
            WHEN 'unit' THEN 'int' ELSE 'double' END AS dtype, missing_count, missing_ratio FROM report""",
)
def column_profile(spark, sf):
    return quality.column_profile(readouts(spark, sf))


@query(
    "constant_columns",
    f"""WITH {CELLS}, wide AS (
          SELECT feature, v FROM cells UNION ALL SELECT 'unit', unit FROM readouts UNION ALL SELECT 'blank', blank FROM readouts)
        SELECT feature AS "column" FROM wide GROUP BY feature HAVING count(v) = 0 OR min(v) = max(v)""",
)
def constant_columns(spark, sf):
    return quality.constant_columns(readouts(spark, sf), [*FEATURES, "unit", "blank"])


@query(
    "constant_columns_null_is_a_value",
    """WITH c AS (SELECT 'l_linenumber' AS "column", CAST(l_linenumber AS VARCHAR) AS v FROM lineitem
         UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
         UNION ALL SELECT 'some_sevens', CASE WHEN l_tax > 0 THEN '7' END FROM lineitem
         UNION ALL SELECT 'sevens', '7' FROM lineitem UNION ALL SELECT 'nothing', NULL FROM lineitem)
       SELECT "column" FROM c GROUP BY "column" HAVING count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) <= 1""",
)
def constant_columns_null_is_a_value(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_linenumber",
        "l_linestatus",
        F.when(F.col("l_tax") > 0, F.lit("7")).alias("some_sevens"),
        F.lit("7").alias("sevens"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return quality.constant_columns(df, nulls="value")


@query(
    "safe_numeric",
    f"WITH {CLEAN} SELECT entity_id, t, price, coalesce(discount, 0.5) AS discount, tax FROM clean",
)
def safe_numeric_query(spark, sf):
    return readouts(spark, sf).select(
        "entity_id", "t", "price", safe_numeric("discount", 0.5).alias("discount"), safe_numeric("tax").alias("tax")
    )


@query("drop_sparse_columns", f"WITH {READOUTS} SELECT entity_id, t, quantity, price, discount, tax, unit FROM readouts")
def drop_sparse_columns(spark, sf):
    return preprocess.drop_sparse_columns(readouts(spark, sf))


# --- time ------------------------------------------------------------------

_GAPS = """g AS (
  SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) AS t,
         CAST(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS DOUBLE) AS prev_time FROM events)"""


def _events(spark, sf):
    from trajlens.functions.expressions import epoch_micros

    return table(spark, sf, "events").select("user_id", epoch_micros("ts").alias("t"), "value")


@query("gaps", f"WITH {_GAPS} SELECT user_id, t, prev_time, t - prev_time AS gap FROM g WHERE prev_time IS NOT NULL")
def gaps(spark, sf):
    return temporal.gaps(_events(spark, sf), "user_id", "t")


@query(
    "gap_report",
    f"""WITH {READOUTS}, g AS (
          SELECT CAST(t - lag(t) OVER (PARTITION BY entity_id ORDER BY t) AS DOUBLE) AS gap FROM readouts)
        SELECT count(gap) AS n_gaps, round(avg(gap), 6) AS mean_gap, quantile_disc(gap, 0.5) AS median_gap,
               quantile_disc(gap, 0.95) AS p95_gap, min(gap) AS min_gap, max(gap) AS max_gap FROM g WHERE gap IS NOT NULL""",
)
def gap_report(spark, sf):
    return rounded(temporal.gap_report(readouts(spark, sf), "entity_id", "t", exact=True))


@query("length_per_entity", "SELECT o_custkey, count(*) AS n_records FROM orders GROUP BY 1")
def length_per_entity(spark, sf):
    return temporal.length_per_entity(table(spark, sf, "orders"), "o_custkey")


@query(
    "length_report",
    """SELECT count(n) AS n_entities, round(avg(n), 6) AS mean_records, quantile_disc(n, 0.5) AS median_records,
              quantile_disc(n, 0.05) AS p05_records, quantile_disc(n, 0.95) AS p95_records,
              min(n) AS min_records, max(n) AS max_records
       FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_custkey)""",
)
def length_report(spark, sf):
    report = rounded(temporal.length_report(table(spark, sf, "orders"), "o_custkey", exact=True))
    return report.select(*[F.col(c).cast("double").alias(c) if c.endswith("records") else c for c in report.columns])


# --- labels ----------------------------------------------------------------


@query(
    "binary_label",
    """SELECT o_orderkey, CASE WHEN k IS NULL THEN NULL WHEN k > 0 THEN 1 ELSE 0 END AS y
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 - 1 END AS k FROM orders)""",
)
def binary_label_query(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", binary_label(F.when(key % 7 != 0, key % 5 - 1)).alias("y")
    )


_ENTITY_LABELS = ORDER_CLASSES + """, entity_labels AS (
  SELECT entity_id, max(CASE WHEN class_label IS NULL THEN NULL WHEN class_label > 0 THEN 1 ELSE 0 END) AS y_true
  FROM order_classes GROUP BY 1)"""


@query("entity_labels", f"WITH {_ENTITY_LABELS} SELECT entity_id, y_true FROM entity_labels")
def entity_labels(spark, sf):
    return labels.entity_labels(order_classes(spark, sf), "entity_id")


@query(
    "attach_labels",
    f"""WITH {_ENTITY_LABELS}
        SELECT o.o_orderkey, o.o_custkey AS entity_id, coalesce(e.y_true, -1) AS y_true
        FROM orders o LEFT JOIN entity_labels e ON o.o_custkey = e.entity_id""",
)
def attach_labels(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"))
    return labels.attach_labels(orders, order_classes(spark, sf), "entity_id")


@query(
    "keep_normal",
    f"""WITH {CLEAN}, {REPAIRS} SELECT c.entity_id, c.t, c.price FROM clean c JOIN repairs r USING (entity_id)
        WHERE r.in_study_repair = 0""",
)
def keep_normal(spark, sf):
    return labels.keep_normal(readouts(spark, sf).select("entity_id", "t", "price"), repairs(spark, sf), "entity_id")


@query(
    "label_summary",
    f"""WITH {_ENTITY_LABELS} SELECT count(y_true) AS total_labeled, count(*) FILTER (y_true = 0) AS normal,
          count(*) FILTER (y_true = 1) AS positive,
          round(count(*) FILTER (y_true = 1) / count(y_true), 6) AS positive_ratio, 'class_label' AS label_column
        FROM entity_labels""",
)
def label_summary(spark, sf):
    return rounded(labels.label_summary(order_classes(spark, sf), "entity_id"))


@query(
    "class_distribution",
    f"""WITH {ORDER_CLASSES}, {CLASSES}
        SELECT 'orders' AS source, CAST(class_label AS INTEGER) AS class_label, count(*) AS count FROM order_classes WHERE class_label IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'suppliers', class_label, count(*) FROM classes GROUP BY 2""",
)
def class_distribution(spark, sf):
    return labels.class_distribution({"orders": order_classes(spark, sf), "suppliers": classes(spark, sf)})


@query(
    "binary_distribution",
    f"""WITH {_ENTITY_LABELS}, {CLASSES}, {REPAIRS}, y AS (
          SELECT 'orders' AS source, y_true FROM entity_labels
          UNION ALL SELECT 'suppliers', max(CAST(class_label > 0 AS INTEGER)) FROM classes GROUP BY entity_id
          UNION ALL SELECT 'repairs', max(in_study_repair) FROM repairs GROUP BY entity_id)
        SELECT source, count(*) FILTER (y_true = 0) AS normal, count(*) FILTER (y_true = 1) AS outlier_or_repair,
               count(y_true) AS total, round(count(*) FILTER (y_true = 1) / count(y_true), 6) AS positive_ratio
        FROM y GROUP BY source""",
)
def binary_distribution(spark, sf):
    tables = {"orders": order_classes(spark, sf), "suppliers": classes(spark, sf), "repairs": repairs(spark, sf)}
    return rounded(labels.binary_distribution(tables, "entity_id"))


# --- sampling --------------------------------------------------------------


@query(
    "stratified_entities",
    f"""WITH {_ENTITY_LABELS}, sizes AS (
          SELECT count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS q FROM entity_labels),
        chosen AS (SELECT least(greatest(2, CAST(round_even(60 * (p / (p + q)), 0) AS BIGINT)), p, 59) AS n_pos, q FROM sizes),
        ranked AS (SELECT entity_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY entity_id) AS rn
                   FROM entity_labels WHERE y_true IS NOT NULL)
        SELECT entity_id FROM ranked, chosen WHERE rn <= CASE y_true WHEN 1 THEN n_pos ELSE least(60 - n_pos, q) END""",
)
def stratified_entities(spark, sf):
    return sampling.stratified_entities(order_classes(spark, sf), "entity_id", 60)


@query(
    "normal_entities",
    f"WITH {REPAIRS} SELECT DISTINCT entity_id FROM repairs WHERE in_study_repair = 0 ORDER BY entity_id LIMIT 25",
)
def normal_entities(spark, sf):
    return sampling.normal_entities(repairs(spark, sf), "entity_id", 25)


@query("first_entities", "SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25")
def first_entities(spark, sf):
    return sampling.first_entities(table(spark, sf, "events"), "user_id", 25)


@query("entities", "SELECT DISTINCT user_id FROM events")
def entities(spark, sf):
    return sampling.entities(table(spark, sf, "events"), "user_id")


@query(
    "restrict",
    """SELECT event_id, user_id, value FROM events
       WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25)""",
)
def restrict(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return sampling.restrict(events, sampling.first_entities(events, "user_id", 25), "user_id")


@query(
    "bounded_sample",
    """WITH r AS (
          SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price,
                 CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, 42)), 1, 12)) AS BIGINT) / 281474976710656.0 AS drawn
          FROM lineitem)
        SELECT l_orderkey, l_linenumber, quantity, price FROM r WHERE drawn < 0.02
        ORDER BY drawn, l_orderkey, l_linenumber LIMIT 5000""",
)
def bounded_sample(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")
    )
    return sampling.bounded_sample(lines, ["quantity", "price"], ["l_orderkey", "l_linenumber"])


# --- distributions ---------------------------------------------------------


def _histogram_sql(cells: str, keys: str) -> str:
    """numpy's rule as edges: a value belongs to the last edge that is not above it."""
    using = keys.replace(" ", "")
    return f"""{cells}, r AS (
      SELECT {keys}, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
      FROM cells WHERE v IS NOT NULL GROUP BY {keys}),
    edges AS (
      SELECT {keys}, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 30.0::DOUBLE) AS low,
             CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30.0::DOUBLE) END AS high
      FROM r, range(30) AS s(i)),
    counted AS (
      SELECT {keys}, bin, count(*) AS count FROM edges JOIN cells USING ({using})
      WHERE v >= low AND (v < high OR bin = 29) GROUP BY {keys}, bin)
    SELECT {keys}, bin, round(low, 6) AS low, round(high, 6) AS high, coalesce(count, 0) AS count
    FROM edges LEFT JOIN counted USING ({using}, bin)"""


@query("histogram", "WITH " + _histogram_sql(CELLS, "feature"))
def histogram(spark, sf):
    return rounded(profile.histogram(readouts(spark, sf), FEATURES))


_SCORE_CELLS = SCORES + """, cells AS (
  SELECT model, y_true, 'outlier_score' AS feature, outlier_score AS v FROM scores WHERE y_true >= 0)"""


@query("histogram_by_class", "WITH " + _histogram_sql(_SCORE_CELLS, "model, y_true, feature"))
def histogram_by_class(spark, sf):
    known = scores(spark, sf).where(F.col("y_true") >= 0)
    return rounded(profile.histogram(known, ["outlier_score"], by=["model", "y_true"]))


def _boxplot_sql(cells: str, keys: str) -> str:
    using = keys.replace(" ", "")
    return f"""{cells}, q AS (
      SELECT {keys}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM cells WHERE v IS NOT NULL GROUP BY {keys})
    SELECT {keys}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           round(least(q1, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1))), 6) AS whisker_low,
           round(greatest(q3, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1))), 6) AS whisker_high, count(*) AS n
    FROM cells JOIN q USING ({using}) WHERE v IS NOT NULL GROUP BY {keys}, q1, median, q3"""


@query("boxplot_stats", "WITH " + _boxplot_sql(CELLS, "feature"))
def boxplot_stats(spark, sf):
    return rounded(profile.boxplot_stats(readouts(spark, sf), FEATURES))


@query("boxplot_by_class", "WITH " + _boxplot_sql(_SCORE_CELLS, "model, y_true, feature"))
def boxplot_by_class(spark, sf):
    known = scores(spark, sf).where(F.col("y_true") >= 0)
    return rounded(profile.boxplot_stats(known, ["outlier_score"], by=["model", "y_true"]))


@query(
    "correlation",
    f"""WITH {CLEAN}, m AS (
          SELECT median(quantity) AS a, median(price) AS b, median(discount) AS c, median(tax) AS d FROM clean),
        f AS (SELECT quantity AS a, price AS b, coalesce(discount, m.c) AS c, coalesce(tax, m.d) AS d FROM clean, m),
        k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(a, d) AS ad, corr(b, c) AS bc, corr(b, d) AS bd, corr(c, d) AS cd FROM f),
        p AS (SELECT 'quantity' AS x, 'price' AS y, ab AS r FROM k UNION ALL SELECT 'quantity', 'discount', ac FROM k
          UNION ALL SELECT 'quantity', 'tax', ad FROM k UNION ALL SELECT 'price', 'discount', bc FROM k
          UNION ALL SELECT 'price', 'tax', bd FROM k UNION ALL SELECT 'discount', 'tax', cd FROM k)
        SELECT x AS feature_a, y AS feature_b, round(r, 6) AS correlation FROM p
        UNION ALL SELECT y, x, round(r, 6) FROM p
        UNION ALL SELECT unnest(['quantity', 'price', 'discount', 'tax']), unnest(['quantity', 'price', 'discount', 'tax']), 1.0""",
)
def correlation(spark, sf):
    return rounded(profile.correlation(readouts(spark, sf), [*FEATURES, "unit", "blank"]))


# Numeric columns of three joined tables, more than a plot would show.
_WIDE = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
    " o_orderkey o_custkey o_totalprice c_custkey c_nationkey c_acctbal"
).split()
_WIDE_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("1.0" if a == b else f"round(corr({a}, {b}), 6)") + " AS correlation FROM w"
    + (" HAVING count(*) > 0" if a == b else "")
    for a in _WIDE
    for b in _WIDE
)


@query(
    "correlation_wide",
    f"""WITH w AS (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _WIDE)} FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) {_WIDE_PAIRS}""",
)
def correlation_wide(spark, sf):
    wide = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return rounded(profile.correlation(wide.select(*_WIDE), _WIDE))


# --- compositions ----------------------------------------------------------


@query(
    "profile_tables",
    f"""WITH {READOUTS}, {CLASSES}, {REPAIRS}, m AS (
          SELECT 'readouts' AS source, 'discount' AS "column", count(*) - count(discount) AS missing_count, count(*) AS n FROM readouts
          UNION ALL SELECT 'readouts', 'tax', count(*) FILTER (isnan(tax)), count(*) FROM readouts
          UNION ALL SELECT 'readouts', 'blank', count(*) - count(blank), count(*) FROM readouts
          UNION ALL SELECT 'readouts', unnest(['entity_id', 't', 'quantity', 'price', 'unit']), 0, count(*) FROM readouts
          UNION ALL SELECT 'labels', unnest(['entity_id', 'class_label']), 0, count(*) FROM classes
          UNION ALL SELECT 'repairs', unnest(['entity_id', 'in_study_repair']), 0, count(*) FROM repairs)
        SELECT source, "column", missing_count, round(missing_count / n, 6) AS missing_ratio FROM m""",
)
def profile_query(spark, sf):
    reports = profile_tables(
        {"readouts": readouts(spark, sf), "labels": classes(spark, sf), "repairs": repairs(spark, sf)},
        ROLES,
        readouts=["readouts"],
        label_tables={"labels": "class_label", "repairs": "in_study_repair"},
        feature_table="readouts",
    )
    return rounded(reports["missing"])


# --- files and fingerprints: content depends on files, so no SQL twin -------


@query("table_check")
def table_check(spark, sf):
    files = {"readouts": "lineitem.parquet", "labels": "supplier.parquet", "absent": "absent.parquet"}
    return TableSet(spark, files, [f"{sf}/first", sf]).check()


@query(
    "read_available",
    """SELECT 'labels' AS alias, count(*) AS n_rows FROM supplier UNION ALL SELECT 'readouts', count(*) FROM lineitem""",
)
def read_available(spark, sf):
    files = {"readouts": "lineitem.parquet", "labels": "supplier.parquet", "absent": "absent.parquet"}
    found = TableSet(spark, files, [sf]).read_available()
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(a).alias("alias"), "n_rows") for a, df in found.items()]
    return parts[0].unionByName(parts[1])


@query("file_inventory")
def file_inventory(spark, sf):
    return lineage.inventory(spark, sf)


@query("file_hashes")
def file_hashes(spark, sf):
    return lineage.file_hashes(spark, sf).select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "size_bytes", "sha256")


@query("table_fingerprint")
def table_fingerprint(spark, sf):
    return lineage.fingerprint(readouts(spark, sf), "debug_025", "readouts", {"window_size": 30, "stride": 5})

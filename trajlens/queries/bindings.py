"""The shared test tables in the roles of readouts, labels, scores and metric rows.

Each binding exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.operators import preprocess
from trajlens.operators.labels import keep_normal
from trajlens.operators.preprocess import FittedPreprocessing
from trajlens.operators.windows import build_windows
from trajlens.roles import Roles

ROLES = Roles("entity_id", "t", "y_true")
FEATURES = ["quantity", "price", "discount", "tax"]
SIZE, STRIDE = 30, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.unix_date(F.col(column).cast("date")).cast("long")


# --- readouts: one supplier's shipments as a trajectory ---------------------

READOUTS = """readouts AS (
  SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS t,
         l_quantity AS quantity, l_extendedprice AS price,
         CASE WHEN l_discount <> 0 THEN l_discount END AS discount,
         CASE WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS tax,
         7 AS unit, CAST(NULL AS DOUBLE) AS blank
  FROM lineitem)"""


def readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        day("l_shipdate").alias("t"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
        F.lit(7).alias("unit"),
        F.lit(None).cast("double").alias("blank"),
    )


# NaN turned into null, all four features
CLEAN = (
    READOUTS
    + """, clean AS (
  SELECT entity_id, t, quantity, price, discount, CASE WHEN isnan(tax) THEN NULL ELSE tax END AS tax
  FROM readouts)"""
)

# One row per value: (feature, v)
CELLS = (
    CLEAN
    + """, cells AS (
  SELECT 'quantity' AS feature, quantity AS v FROM clean UNION ALL SELECT 'price', price FROM clean
  UNION ALL SELECT 'discount', discount FROM clean UNION ALL SELECT 'tax', tax FROM clean)"""
)

# --- labels of suppliers ----------------------------------------------------

CLASSES = """classes AS (
  SELECT s_suppkey AS entity_id, n_regionkey AS class_label
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

REPAIRS = """repairs AS (
  SELECT s_suppkey AS entity_id, CAST(s_acctbal < 0 AS INTEGER) AS in_study_repair FROM supplier)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).select(
        F.col("s_suppkey").alias("entity_id"), F.col("n_regionkey").alias("class_label")
    )


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entity_id"), (F.col("s_acctbal") < 0).cast("int").alias("in_study_repair")
    )


# The official split of suppliers, by nation
SPLITS = """splits AS (
  SELECT s_suppkey AS entity_id,
         CASE WHEN s_nationkey < 12 THEN 'train' WHEN s_nationkey < 18 THEN 'validation' ELSE 'test' END AS split
  FROM supplier)"""


def splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Readouts of each split."""
    nation = F.col("s_nationkey")
    split = F.when(nation < 12, "train").when(nation < 18, "validation").otherwise("test")
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), split.alias("split"))
    rows = readouts(spark, sf_dir)
    return {
        name: rows.join(known.where(F.col("split") == name).select("entity_id"), "entity_id", "left_semi")
        for name in ("train", "validation", "test")
    }


# Several labels per entity, some null: orders of a customer
ORDER_CLASSES = """order_classes AS (
  SELECT o_custkey AS entity_id,
         CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL
              WHEN o_custkey % 3 = 0 THEN -(o_orderkey % 2) ELSE o_orderkey % 5 END AS class_label
  FROM orders)"""


def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, key = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        entity.alias("entity_id"),
        F.when((entity % 5 == 0) | (key % 7 == 0), F.lit(None))
        .when(entity % 3 == 0, -(key % 2))
        .otherwise(key % 5)
        .alias("class_label"),
    )


# --- splits and windows -----------------------------------------------------

# Fitted on the normal suppliers of the train split; median fill, population std.
PARAMETERS = (
    CLEAN
    + ", "
    + REPAIRS
    + ", "
    + SPLITS
    + """, train AS (
  SELECT c.* FROM clean c JOIN repairs r USING (entity_id) JOIN splits p USING (entity_id)
  WHERE p.split = 'train' AND r.in_study_repair = 0),
fill AS (
  SELECT quantile_disc(quantity, 0.5) AS f0, quantile_disc(price, 0.5) AS f1,
         quantile_disc(discount, 0.5) AS f2, quantile_disc(tax, 0.5) AS f3 FROM train),
params AS (
  SELECT f0, f1, f2, f3,
         avg(coalesce(quantity, f0)) AS m0, avg(coalesce(price, f1)) AS m1,
         avg(coalesce(discount, f2)) AS m2, avg(coalesce(tax, f3)) AS m3,
         stddev_pop(coalesce(quantity, f0)) AS s0, stddev_pop(coalesce(price, f1)) AS s1,
         stddev_pop(coalesce(discount, f2)) AS s2, stddev_pop(coalesce(tax, f3)) AS s3
  FROM train, fill GROUP BY f0, f1, f2, f3)"""
)

SCALED = (
    PARAMETERS
    + """, scaled AS (
  SELECT entity_id, t, (coalesce(quantity, f0) - m0) / s0 AS x0, (coalesce(price, f1) - m1) / s1 AS x1,
         (coalesce(discount, f2) - m2) / s2 AS x2, (coalesce(tax, f3) - m3) / s3 AS x3
  FROM clean, params)"""
)

# (entity_id, start_idx, pos, t, x0..x3): one row per step of every window
WINDOW_STEPS = (
    SCALED
    + f""", steps AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t, x0, x1, x2, x3) - 1 AS idx,
         count(*) OVER (PARTITION BY entity_id) AS n FROM scaled),
window_steps AS (
  SELECT a.entity_id, a.idx AS start_idx, b.idx - a.idx AS pos, b.t, b.x0, b.x1, b.x2, b.x3
  FROM steps a JOIN steps b ON a.entity_id = b.entity_id AND b.idx BETWEEN a.idx AND a.idx + {SIZE - 1}
  WHERE a.idx % {STRIDE} = 0 AND a.idx + {SIZE} <= a.n)"""
)

ENTITY_Y = CLASSES + ", entity_y AS (SELECT entity_id, max(CASE WHEN class_label > 0 THEN 1 ELSE 0 END) AS y FROM classes GROUP BY 1)"

# Scores of the per-position training mean
MEAN_SCORES = (
    WINDOW_STEPS
    + ", "
    + ENTITY_Y
    + f""", mean_profile AS (
  SELECT pos, avg(x0) AS p0, avg(x1) AS p1, avg(x2) AS p2, avg(x3) AS p3
  FROM window_steps JOIN repairs USING (entity_id) JOIN splits USING (entity_id)
  WHERE split = 'train' AND in_study_repair = 0 GROUP BY pos),
window_scores AS (
  SELECT entity_id, start_idx, min(t) AS start_t, max(t) AS end_t,
         sum((x0 - p0) ** 2 + (x1 - p1) ** 2 + (x2 - p2) ** 2 + (x3 - p3) ** 2) / {SIZE * 4} AS score
  FROM window_steps JOIN mean_profile USING (pos) GROUP BY entity_id, start_idx)"""
)


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_normal(splits(spark, sf_dir)["train"], repairs(spark, sf_dir), "entity_id")


def fitted(spark: SparkSession, sf_dir: str) -> FittedPreprocessing:
    return preprocess.fit(train_rows(spark, sf_dir), roles=ROLES)


def split_windows(spark: SparkSession, sf_dir: str, df: DataFrame, parameters: FittedPreprocessing) -> DataFrame:
    scaled = preprocess.apply(df, parameters, ROLES, dtype="double")
    return build_windows(scaled, parameters.scaled_columns, "entity_id", "t", "y_true", SIZE, STRIDE, dtype="double")


# --- scored rows: events of a user as windows, event type as model ----------

SCORES = """scores AS (
  SELECT CAST(event_id AS VARCHAR) AS window_id, user_id AS entity_id, event_type AS model, value AS outlier_score,
         CASE WHEN user_id % 11 = 0 THEN -1 WHEN (user_id + event_id) % 4 = 0 THEN 1 ELSE 0 END AS y_true,
         CAST(value > 20 AS INTEGER) AS is_outlier
  FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.cast("string").alias("window_id"),
        user.alias("entity_id"),
        F.col("event_type").alias("model"),
        F.col("value").alias("outlier_score"),
        F.when(user % 11 == 0, -1).when((user + event) % 4 == 0, 1).otherwise(0).alias("y_true"),
        (F.col("value") > 20).cast("int").alias("is_outlier"),
    )


# Few distinct scores, so ties matter: part sizes
PART_SCORES = """part_scores AS (
  SELECT p_brand AS model, CAST(p_size AS DOUBLE) AS outlier_score,
         CASE WHEN p_partkey % 13 = 0 THEN -1 WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS y_true,
         CAST(p_size > 25 AS INTEGER) AS is_outlier
  FROM part)"""


def part_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model"),
        F.col("p_size").cast("double").alias("outlier_score"),
        F.when(key % 13 == 0, -1).when(key % 3 == 0, 1).otherwise(0).alias("y_true"),
        (F.col("p_size") > 25).cast("int").alias("is_outlier"),
    )


# --- metric rows: line numbers as runs, return flags as models --------------

METRIC_ROWS = """metric_rows AS (
  SELECT CASE l_linenumber WHEN 7 THEN 'full' WHEN 6 THEN 'pilot'
              ELSE 'debug_' || lpad(CAST(l_linenumber * 25 AS VARCHAR), 3, '0') END AS run_name,
         l_returnflag AS model, 'vehicle' AS level,
         round(avg(l_discount) * 10, 6) AS precision, round(avg(l_tax) * 12, 6) AS recall,
         CASE WHEN l_linenumber = 4 THEN NULL ELSE round(avg(l_quantity) / 50, 2) END AS f1_score,
         round(avg(l_tax) * 20, 6) AS roc_auc,
         CASE WHEN l_linenumber = 2 OR (l_linenumber = 3 AND l_returnflag = 'A') THEN NULL
              ELSE round(avg(l_discount) * 10, 2) END AS pr_auc,
         round(sum(l_quantity) / 1000, 3) AS training_time_seconds,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE round(count(*) / 100.0::DOUBLE, 3) END AS inference_time_seconds
  FROM lineitem GROUP BY l_linenumber, l_returnflag)"""


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(
        nearest(F.avg("l_discount") * 10, 6).alias("precision"),
        nearest(F.avg("l_tax") * 12, 6).alias("recall"),
        nearest(F.avg("l_quantity") / 50, 2).alias("_f1"),
        nearest(F.avg("l_tax") * 20, 6).alias("roc_auc"),
        nearest(F.avg("l_discount") * 10, 2).alias("_ap"),
        nearest(F.sum("l_quantity") / 1000, 3).alias("training_time_seconds"),
        nearest(F.count(F.lit(1)) / F.lit(100.0), 3).alias("_inference"),
    )
    run = (
        F.when(line == 7, F.lit("full"))
        .when(line == 6, F.lit("pilot"))
        .otherwise(F.concat(F.lit("debug_"), F.lpad((line * 25).cast("string"), 3, "0")))
    )
    no_ap = (line == 2) | ((line == 3) & (flag == "A"))
    return grouped.select(
        run.alias("run_name"),
        flag.alias("model"),
        F.lit("vehicle").alias("level"),
        "precision",
        "recall",
        F.when(line != 4, F.col("_f1")).alias("f1_score"),
        "roc_auc",
        F.when(~no_ap, F.col("_ap")).alias("pr_auc"),
        "training_time_seconds",
        F.when(flag != "R", F.col("_inference")).alias("inference_time_seconds"),
    )


def nearest(column, digits: int):
    """A double rounded as SQL's ``round`` does: scaled, rounded half away from zero, scaled back.

    Spark's own ``round`` works on the decimal text, so it differs on ties such as 41 / 640 to six digits.
    """
    value = F.col(column) if isinstance(column, str) else column
    scaled = F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(float("inf")), scaled).otherwise(value)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; no negative zero."""
    near = {"double": nearest, "float": F.round}
    return df.select(*[(near[t](c, digits) + F.lit(0.0)).alias(c) if t in near else F.col(c) for c, t in df.dtypes])

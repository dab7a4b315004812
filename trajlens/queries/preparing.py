"""Queries over feature preparation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import preprocess, windows
from trajlens.operators.ordering import shared_folder
from trajlens.plans import PrepareConfig, prepare
from trajlens.queries.bindings import (
    CELLS,
    ENTITY_Y,
    FEATURES,
    PARAMETERS,
    READOUTS,
    ROLES,
    SCALED,
    SIZE,
    SPLITS,
    STRIDE,
    WINDOW_STEPS,
    classes,
    day,
    fitted,
    nearest,
    readouts,
    repairs,
    rounded,
    split_windows,
    splits,
    table,
)
from trajlens.queries.registry import query

# --- preprocessing ---------------------------------------------------------

_SELECTION = f"""WITH {CELLS}, wide AS (
  SELECT feature, v FROM cells UNION ALL SELECT 'unit', unit FROM readouts UNION ALL SELECT 'blank', blank FROM readouts),
s AS (SELECT feature, (count(*) - count(v)) / count(*) > 0.8 AS sparse,
             count(v) = 0 OR min(v) = max(v) AS constant FROM wide GROUP BY feature)"""


@query("select_features", _SELECTION + " SELECT feature, NOT (sparse OR constant) AS selected, sparse, constant FROM s")
def select_features(spark, sf):
    return preprocess.select_features(readouts(spark, sf), [*FEATURES, "unit", "blank"]).drop("ordinal")


@query(
    "selection_summary",
    _SELECTION
    + """ SELECT reason, count(*) AS count FROM (
           SELECT 'selected' AS reason FROM s WHERE NOT (sparse OR constant)
           UNION ALL SELECT 'missing_ratio' FROM s WHERE sparse UNION ALL SELECT 'constant' FROM s WHERE constant)
         GROUP BY reason""",
)
def selection_summary(spark, sf):
    return preprocess.selection_summary(preprocess.select_features(readouts(spark, sf), [*FEATURES, "unit", "blank"]))


@query(
    "fit_imputation_median",
    f"WITH {CELLS} SELECT feature, quantile_disc(v, 0.5) AS imputation_value FROM cells GROUP BY feature",
)
def fit_imputation_median(spark, sf):
    return preprocess.fit_imputation(readouts(spark, sf), FEATURES)


@query(
    "fit_imputation_mean",
    f"WITH {CELLS} SELECT feature, round(avg(v), 6) AS imputation_value FROM cells GROUP BY feature",
)
def fit_imputation_mean(spark, sf):
    return rounded(preprocess.fit_imputation(readouts(spark, sf), FEATURES, strategy="mean"))


@query(
    "fit_scaling",
    f"""WITH {CELLS} SELECT feature, round(avg(coalesce(v, 0.03)), 6) AS mean, round(stddev_pop(coalesce(v, 0.03)), 6) AS std
        FROM cells GROUP BY feature""",
)
def fit_scaling(spark, sf):
    return rounded(preprocess.fit_scaling(readouts(spark, sf), FEATURES, {c: 0.03 for c in FEATURES}))


@query(
    "fit_parameters",
    f"""WITH {PARAMETERS}
        SELECT 'quantity' AS feature, 'x_0' AS scaled_name, f0 AS imputation_value, round(m0, 6) AS mean, round(s0, 6) AS std FROM params
        UNION ALL SELECT 'price', 'x_1', f1, round(m1, 6), round(s1, 6) FROM params
        UNION ALL SELECT 'discount', 'x_2', f2, round(m2, 6), round(s2, 6) FROM params
        UNION ALL SELECT 'tax', 'x_3', f3, round(m3, 6), round(s3, 6) FROM params""",
)
def fit_parameters(spark, sf):
    return rounded(fitted(spark, sf).parameters(spark))


@query(
    "apply_preprocessing",
    f"""WITH {SCALED} SELECT entity_id, t, round(x0, 6) + 0 AS x_0, round(x1, 6) + 0 AS x_1, round(x2, 6) + 0 AS x_2,
        round(x3, 6) + 0 AS x_3 FROM scaled""",
)
def apply_preprocessing(spark, sf):
    parameters = fitted(spark, sf).parameters(spark)  # through the table, as a stored fit would be used
    return rounded(preprocess.apply(readouts(spark, sf), parameters, ROLES, dtype="double"))


# --- windows ---------------------------------------------------------------


def _checksum():
    """Sum of the cells weighted by their place, so that any reordering shows."""
    cells = F.flatten("X")
    terms = F.transform(cells, lambda x, i: x * (i + 1).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _digest(df):
    return df.select(
        "window_id", "entity_id", "start_idx", "start_time_step", "end_time_step",
        (nearest(_checksum(), 4) + F.lit(0.0)).alias("checksum"), "y_true",
    )


@query(
    "build_windows",
    f"""WITH {WINDOW_STEPS}
        SELECT entity_id || '_' || start_idx AS window_id, entity_id, CAST(start_idx AS INTEGER) AS start_idx,
               min(t) AS start_time_step, max(t) AS end_time_step,
               round(sum((4 * pos + 1) * x0 + (4 * pos + 2) * x1 + (4 * pos + 3) * x2 + (4 * pos + 4) * x3), 4) + 0 AS checksum,
               -1 AS y_true
        FROM window_steps GROUP BY entity_id, start_idx""",
)
def build_windows(spark, sf):
    return _digest(split_windows(spark, sf, readouts(spark, sf), fitted(spark, sf)))


_SHORT = """s AS (
  SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS t, o_totalprice AS v,
         row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_totalprice) - 1 AS idx,
         count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), day("o_orderdate").alias("t"), F.col("o_totalprice").alias("v")
    )


@query(
    "build_windows_short",
    f"""WITH {_SHORT}
        SELECT a.entity_id || '_' || a.idx AS window_id, CAST(b.idx - a.idx AS INTEGER) AS pos, b.v AS value
        FROM s a JOIN s b ON a.entity_id = b.entity_id AND b.idx BETWEEN a.idx AND a.idx + 4
        WHERE a.idx % 2 = 0 AND a.idx + 5 <= a.n""",
)
def build_windows_short(spark, sf):
    built = windows.build_windows(_orders(spark, sf), ["v"], "entity_id", "t", size=5, stride=2, dtype="double")
    steps = built.select("window_id", F.posexplode("X").alias("pos", "x"))
    return steps.select("window_id", "pos", F.get("x", F.lit(0)).alias("value"))


_LABELLED_STEPS = f"""WITH {READOUTS}, s AS (
  SELECT entity_id, CASE WHEN quantity > 45 THEN 1 WHEN quantity > 30 THEN NULL ELSE 0 END AS y,
         row_number() OVER (PARTITION BY entity_id ORDER BY t, price) - 1 AS idx, count(*) OVER (PARTITION BY entity_id) AS n
  FROM readouts)"""


@query(
    "window_labels",
    _LABELLED_STEPS
    + """ SELECT a.entity_id || '_' || a.idx AS window_id, greatest(coalesce(max(b.y), -1), -1) AS y_true
         FROM s a JOIN s b ON a.entity_id = b.entity_id AND b.idx BETWEEN a.idx AND a.idx + 5
         WHERE a.idx % 4 = 0 AND a.idx + 6 <= a.n GROUP BY a.entity_id, a.idx""",
)
def window_labels(spark, sf):
    quantity = F.col("quantity")
    rows = readouts(spark, sf).withColumn("y_true", F.when(quantity > 45, 1).when(quantity <= 30, 0))
    built = windows.build_windows(
        rows, ["price"], "entity_id", "t", "y_true", size=6, stride=4, label_policy="max_label_in_window", dtype="double"
    )
    return built.select("window_id", "y_true")


@query(
    "trajectories",
    f"""WITH {_SHORT} SELECT entity_id, 0 AS part, CAST(n AS INTEGER) AS n_steps, CAST(idx AS INTEGER) AS pos, t AS time_step, v AS value
        FROM s""",
)
def trajectories(spark, sf):
    built = windows.trajectories(_orders(spark, sf), ["v"], "entity_id", "t", dtype="double")
    steps = built.select("entity_id", "part", "n_steps", F.posexplode("sequence").alias("pos", "step"))
    return steps.select(
        "entity_id", "part", "n_steps", "pos", F.col("step.time_step"), F.get("step.features", F.lit(0)).alias("value")
    )


_PER_ENTITY = f"""WITH {READOUTS}, n AS (SELECT entity_id, count(*) AS n FROM readouts GROUP BY 1),
  w AS (SELECT entity_id, CASE WHEN n >= {SIZE} THEN (n - {SIZE}) // {STRIDE} + 1 ELSE 0 END AS n_windows FROM n)"""


@query(
    "inspect_windows",
    _PER_ENTITY
    + f""" SELECT CAST(sum(n_windows) AS BIGINT) AS n_rows, {SIZE} AS window_size, 4 AS n_features,
          {SIZE} AS min_window_size, 4 AS min_n_features FROM w""",
)
def inspect_windows(spark, sf):
    return windows.inspect_windows(split_windows(spark, sf, readouts(spark, sf), fitted(spark, sf)))


@query(
    "windows_by_split",
    _PER_ENTITY
    + f""", {SPLITS} SELECT split, CAST(sum(n_windows) AS BIGINT) AS n_windows, count(*) AS n_entities
          FROM w JOIN splits USING (entity_id) WHERE n_windows > 0 GROUP BY 1""",
)
def windows_by_split(spark, sf):
    parameters = fitted(spark, sf)
    built = {s: split_windows(spark, sf, df, parameters) for s, df in splits(spark, sf).items()}
    return windows.summary_by_split(built, "entity_id")


@query(
    "write_windows",
    _PER_ENTITY
    + f""" SELECT CAST(sum(n_windows) AS BIGINT) AS n_windows, count(*) AS n_entities, {SIZE} AS window_size, 4 AS n_features
          FROM w WHERE n_windows > 0""",
)
def write_windows(spark, sf):
    built = split_windows(spark, sf, readouts(spark, sf), fitted(spark, sf))
    folder = f"{shared_folder(spark)}/write_windows_query"
    return windows.write_windows(built, folder, "entity_id", files=4, features=FEATURES).drop("output_path")


@query(
    "prepare_windows",
    f"""WITH {WINDOW_STEPS}, {ENTITY_Y}, kept AS (
          SELECT w.*, p.split FROM window_steps w JOIN splits p USING (entity_id) JOIN repairs r USING (entity_id)
          WHERE p.split <> 'train' OR r.in_study_repair = 0)
        SELECT split, k.entity_id || '_' || start_idx AS window_id, CASE split WHEN 'train' THEN -1 ELSE any_value(y) END AS y_true,
               min(t) AS start_time_step, max(t) AS end_time_step,
               round(sum((4 * pos + 1) * x0 + (4 * pos + 2) * x1 + (4 * pos + 3) * x2 + (4 * pos + 4) * x3), 4) + 0 AS checksum
        FROM kept k LEFT JOIN entity_y e ON k.entity_id = e.entity_id GROUP BY split, k.entity_id, start_idx""",
)
def prepare_windows(spark, sf):
    rows, known = splits(spark, sf), classes(spark, sf)
    prepared = prepare(
        rows["train"], rows["validation"], rows["test"], repairs(spark, sf), known, known,
        ROLES, PrepareConfig(dtype="double"),
    )
    parts = [
        _digest(df).select(F.lit(s).alias("split"), "window_id", "y_true", "start_time_step", "end_time_step", "checksum")
        for s, df in prepared.windows.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

"""Overlapping fixed-length windows over every trajectory, and the window table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlens.operators.labels import UNLABELLED
from trajlens.operators.lineage import hash_sums, sums_digest
from trajlens.operators.ordering import (
    MAX_GROUP_ROWS,
    in_chunks,
    large_group_positions,
    large_groups,
    local_table,
    rows_outside,
    with_position,
)

# Defaults of the window step and its label policies.
WINDOW_SIZE = 30
STRIDE = 5
LABEL_POLICIES = ("vehicle_label", "max_label_in_window", "unlabeled")

# Positions of one chunk, and of one stored trajectory part.
CHUNK_ROWS = 1000
TRAJECTORY_PART_ROWS = 50_000
# Window starts of one entity that go to the same file when files are hashed.
FILE_CHUNK_ROWS = 50_000


def _steps(
    df: DataFrame, features: Sequence[str], entity: str, time: str, label: str | None, label_policy: str, dtype: str
) -> DataFrame:
    """``(entity, _time, _x[, _label])``: one row per time step with its feature vector."""
    if not features:
        raise ValueError("at least one feature column is needed")
    if label_policy not in LABEL_POLICIES:
        raise ValueError(f"label_policy must be one of {LABEL_POLICIES}, not {label_policy!r}")
    use_label = label is not None and label in df.columns and label_policy != "unlabeled"
    # The check sits beside the entity, so that a partitioning by the bare column is kept.
    null_entity = F.raise_error(F.lit(f"null in {entity}")).cast(df.schema[time].dataType)
    return df.select(
        F.col(entity),
        F.when(F.col(entity).isNull(), null_entity).otherwise(F.col(time)).alias("_time"),
        F.array(*[F.col(c).cast(dtype) for c in features]).alias("_x"),
        *([F.col(label).cast("int").alias("_label")] if use_label else []),
    )


def _order(steps: DataFrame) -> list[str]:
    """Steps with equal times are ordered by their features from left to right, then by label."""
    return [c for c in ("_time", "_x", "_label") if c in steps.columns]


def build_windows(
    df: DataFrame,
    features: Sequence[str],
    entity: str,
    time: str,
    label: str | None = None,
    size: int = WINDOW_SIZE,
    stride: int = STRIDE,
    label_policy: str = "vehicle_label",
    dtype: str = "float",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(window_id, entity, start_idx, start_time_step, end_time_step, X, y_true)``.

    Windows start at positions 0, stride, 2·stride… and are complete. Steps are
    numbered and gathered in short chunks; a chunk borrows the first
    ``size - 1`` steps of the next one and its windows are slices of it. One
    shuffle by entity serves all of that, and no array grows with a trajectory.
    Trajectories above ``max_group_rows`` are numbered and chunked by many
    tasks, and each chunk is its own shuffle group.
    """
    steps = _steps(df, features, entity, time, label, label_policy, dtype)
    groups = large_groups(steps.select(entity), [entity], max_group_rows)
    usual = steps if groups is None else rows_outside(steps, groups, [entity])
    order = _order(steps)
    chunk = _chunk_length(size, stride, chunk_rows)
    placed = with_position(usual, [entity], order)
    own = placed.groupBy(entity, F.floor(F.col("_idx") / chunk).alias("_chunk")).agg(_gathered(placed).alias("_own"))
    following = Window.partitionBy(entity).orderBy("_chunk")
    head = F.slice("_own", 1, max(size - 1, 1)) if size > 1 else F.slice("_own", 1, 0)
    chunks = own.withColumn("_next", F.lead(head).over(following)).select(
        entity,
        "_chunk",
        F.when(F.col("_next").isNull(), F.col("_own")).otherwise(F.concat("_own", "_next")).alias("_steps"),
    )
    if groups is not None:
        placed = large_group_positions(steps, groups, [entity], order, slice_rows=max(max_group_rows // 4, 1))
        spread = in_chunks(placed, chunk, after=size - 1)
        chunks = chunks.unionByName(
            spread.groupBy(entity, "_chunk").agg(_gathered(placed).alias("_steps"))
        )
    last_start = F.least(F.size("_steps") - size, F.lit(chunk - 1))
    starts = chunks.where(F.size("_steps") >= size).withColumn(
        "_start", F.explode(F.sequence(F.lit(0), last_start, F.lit(stride)))
    )
    cut = starts.select(
        entity,
        (F.col("_chunk") * chunk + F.col("_start")).alias("_idx"),
        F.slice("_steps", F.col("_start") + 1, F.lit(size)).alias("_window"),
    )
    if "_label" in steps.columns:
        # missing and negative labels give -1
        top = F.array_max(F.transform("_window", lambda s: s["_label"]))
        y_true = F.greatest(F.coalesce(top, F.lit(UNLABELLED)), F.lit(UNLABELLED))
    else:
        y_true = F.lit(UNLABELLED)
    return cut.select(
        F.concat_ws("_", F.col(entity).cast("string"), F.col("_idx").cast("string")).alias("window_id"),
        entity,
        F.col("_idx").cast("int").alias("start_idx"),
        F.element_at("_window", 1)["_time"].alias("start_time_step"),
        F.element_at("_window", size)["_time"].alias("end_time_step"),
        F.transform("_window", lambda s: s["_x"]).alias("X"),
        y_true.alias("y_true"),
    )


def _chunk_length(size: int, stride: int, wanted: int) -> int:
    """At least ``wanted`` and ``size`` positions, and a multiple of the stride."""
    return -(-max(wanted, size) // stride) * stride


def _gathered(placed: DataFrame) -> Column:
    """Aggregate: the steps of a chunk in order."""
    return F.sort_array(F.collect_list(F.struct("_idx", *_order(placed))))


def trajectories(
    df: DataFrame,
    features: Sequence[str],
    entity: str,
    time: str,
    label: str | None = None,
    dtype: str = "float",
    part_rows: int = TRAJECTORY_PART_ROWS,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(entity, part, n_steps, sequence)``: ordered arrays of ``(time_step, features[, label])``.

    A trajectory of up to ``part_rows`` steps is one array; a longer one comes as
    consecutive parts 0, 1, 2…, so that no array grows without bound.
    """
    steps = _steps(df, features, entity, time, label, "vehicle_label", dtype)
    groups = large_groups(steps.select(entity), [entity], max_group_rows)
    slice_rows = max((max_group_rows or MAX_GROUP_ROWS) // 4, 1)
    placed = with_position(steps, [entity], _order(steps), groups=groups, slice_rows=slice_rows)
    step = F.struct(
        "_idx",
        F.col("_time").alias("time_step"),
        F.col("_x").alias("features"),
        *([F.col("_label").alias("label")] if "_label" in steps.columns else []),
    )
    parts = (
        placed.withColumn("part", F.floor(F.col("_idx") / part_rows).cast("int"))
        .groupBy(entity, "part")
        .agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    )
    return parts.select(
        entity,
        "part",
        F.size("_steps").alias("n_steps"),
        F.transform("_steps", lambda s: s.dropFields("_idx")).alias("sequence"),
    )


def inspect_windows(windows: DataFrame) -> DataFrame:
    """``(n_rows, window_size, n_features, min_window_size, min_n_features)`` over all rows."""
    length, width = F.size("X"), F.size(F.get("X", F.lit(0)))
    return windows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.max(length), F.lit(0)).alias("window_size"),
        F.coalesce(F.max(width), F.lit(0)).alias("n_features"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_window_size"),
        F.coalesce(F.min(width), F.lit(0)).alias("min_n_features"),
    )


def window_summary(windows: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n_windows, n_entities)``; the entity is reduced before it is counted."""
    per_entity = windows.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_n"))
    return per_entity.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_windows"), F.count(entity).alias("n_entities")
    )


def summary_by_split(splits: dict[str, DataFrame], entity: str) -> DataFrame:
    """``(split, n_windows, n_entities)``."""
    tagged = None
    for split, windows in splits.items():
        part = windows.select(F.lit(split).alias("split"), entity)
        tagged = part if tagged is None else tagged.unionByName(part)
    return window_summary(tagged, entity, ["split"])


@dataclass(frozen=True)
class StoredWindows:
    """What was seen of a window table while it was written."""

    path: str
    n_windows: int
    n_entities: int
    window_size: int
    n_features: int
    content_hash: str


def store_windows(
    windows: DataFrame,
    path: str,
    entity: str,
    files: int | None = None,
    features: Sequence[str] | None = None,
    max_records_per_file: int = 1_000_000,
) -> StoredWindows:
    """Overwrite a Parquet window table; its facts are gathered by the write itself, and nothing is read back.

    With ``files``, rows are hashed by entity and window start, so that one huge
    entity does not end up in one file. A share that outgrows Spark's advisory partition size is
    written by several tasks, as more files, so no task's share grows with the table; tiny shares go
    together. Without ``files`` the partitions of the window step are written as they are. Feature names go to a manifest next to it.
    Entities are counted by their first windows, which start at position 0.
    """
    if files is not None:
        placed = windows.withColumn("_stretch", F.floor(F.col("start_idx") / FILE_CHUNK_ROWS))
        windows = placed.hint("rebalance", files, entity, "_stretch").drop("_stretch")
    seen = Observation()
    zero = F.lit(0)
    observed = windows.observe(
        seen,
        *hash_sums(windows.columns),
        F.count_if((F.col("start_idx") == 0) & F.col(entity).isNotNull()).alias("n_entities"),
        F.coalesce(F.max(F.size("X")), zero).alias("window_size"),
        F.coalesce(F.max(F.size(F.get("X", zero))), zero).alias("n_features"),
    )
    observed.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(path)
    spark = windows.sparkSession
    if features is not None:
        rows = [(i, name) for i, name in enumerate(features)]
        spark.createDataFrame(rows, "ordinal int, feature string").coalesce(1).write.mode("overwrite").parquet(
            f"{path.rstrip('/')}_features"
        )
    facts = seen.get
    digest = sums_digest(facts["n_rows"], facts["_a"], facts["_b"])
    return StoredWindows(
        path, facts["n_rows"], facts["n_entities"], facts["window_size"], facts["n_features"], digest
    )


def write_windows(windows: DataFrame, path: str, entity: str, *args, **settings) -> DataFrame:
    """``store_windows``; returns ``(n_windows, n_entities, window_size, n_features, output_path)``."""
    stored = store_windows(windows, path, entity, *args, **settings)
    row = (stored.n_windows, stored.n_entities, stored.window_size, stored.n_features, stored.path)
    schema = "n_windows long, n_entities long, window_size int, n_features int, output_path string"
    return local_table(windows.sparkSession, [row], schema)


def read_windows(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The window table, with only the columns that are needed."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_feature_names(spark: SparkSession, path: str) -> list[str]:
    """Feature names in the order of the window matrix."""
    manifest = spark.read.parquet(f"{path.rstrip('/')}_features")
    return [r["feature"] for r in manifest.orderBy("ordinal").collect()]


def window_schema(entity: str, entity_type: T.DataType, time_type: T.DataType, dtype: str = "float") -> T.StructType:
    """Schema of a stored window table."""
    cell = T.DoubleType() if dtype == "double" else T.FloatType()
    return T.StructType(
        [
            T.StructField("window_id", T.StringType()),
            T.StructField(entity, entity_type),
            T.StructField("start_idx", T.IntegerType()),
            T.StructField("start_time_step", time_type),
            T.StructField("end_time_step", time_type),
            T.StructField("X", T.ArrayType(T.ArrayType(cell))),
            T.StructField("y_true", T.IntegerType()),
        ]
    )

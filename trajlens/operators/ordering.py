"""Ordered work over groups of any size.

An ordered window puts one whole group into one task. That is right for groups
of ordinary size and fatal for a group that holds a third of the table. The
helpers here count the groups first. Ordinary groups keep the plain window; the
few large ones are range-partitioned on the full sort order, so that many tasks
share one group, and get exact positions from per-partition totals.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Largest group that one task may sort or hold.
MAX_GROUP_ROWS = 1_000_000
# Longest list of large groups that is held in a plan.
LISTED_GROUPS = 10_000

# Plans that cost no more than reading their input.
STORED_PLANS = ("Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation")

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small DataFrame that lives in the plan itself, so reading it starts no tasks."""
    struct = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if any(isinstance(f.dataType, T.TimestampType) for f in struct.fields):
        return spark.createDataFrame(list(rows), struct)  # keeps Python's local-time rule
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow_schema = to_arrow_schema(struct)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=struct)


def once(df: DataFrame) -> DataFrame:
    """The table itself if it only reads, projects and filters stored data, else stored: for inputs that are read several times."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in STORED_PLANS:
            return settled(df)
        children = plan.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return df


def beside(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add to every row what ``facts`` knows about its group; ``facts`` has one row per group.

    Keys match null-safely. The facts are computed once and stored; Spark broadcasts
    them if their size allows. Without keys there is one group, whose values become literals.
    """
    if not keys:
        row = facts.first()
        known = [f for f in facts.schema.fields if f.name not in df.columns]
        return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in known])
    renamed = settled(facts.withColumnsRenamed({k: f"_beside_{k}" for k in keys}))
    condition = F.lit(True)
    for key in keys:
        condition = F.col(key).eqNullSafe(F.col(f"_beside_{key}")) & condition
    return df.join(renamed, condition, how).drop(*[f"_beside_{k}" for k in keys])


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only on a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="trajlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Compute a table once, as files in the shared folder, whose size tells Spark how to join it.

    The files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder and cut the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def large_groups(df: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame | None:
    """``(keys…, _group_rows)`` of the groups above ``max_rows``, or None if there are none.

    A list of at most ``LISTED_GROUPS`` becomes part of the plan. A longer one is a stored table, and Spark chooses
    how to join it.
    """
    if max_rows is None:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_group_rows"))
    large = sizes.where(F.col("_group_rows") > max_rows)
    rows = large.limit(LISTED_GROUPS + 1).collect()
    if len(rows) > LISTED_GROUPS:
        return settled(large)
    return local_table(df.sparkSession, rows, sizes.schema) if rows else None


def _pick(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    if not keys:
        return df if how == "left_semi" else df.limit(0)
    probe = groups.select(*[F.col(k).alias(f"_probe_{k}") for k in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_probe_{key}"))
    return df.join(probe, condition, how)


def rows_of(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _pick(df, groups, keys, "left_semi")


def rows_outside(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _pick(df, groups, keys, "left_anti")


def _sorted_slices(
    df: DataFrame, groups: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int
) -> DataFrame:
    """Rows in global sort order with ``_slice`` and ``_at`` (position inside the slice).

    The random last key splits rows that are equal in every sort column. Slice
    borders are sampled, so the result is checkpointed before it is used twice.
    """
    total = groups.agg(F.sum("_group_rows")).first()[0]
    slices = max(2, -(-int(total) // slice_rows))
    columns = [*keys, *order]
    ordered = (
        df.withColumn("_tie", F.rand(7))
        .repartitionByRange(slices, *columns, "_tie")
        .sortWithinPartitions(*columns, "_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    stored = checkpointed(ordered)
    return stored.withColumn("_slice", F.shiftright("_at", _POSITION_BITS)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    )


def _with_offsets(
    sliced: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """Join to every row what the earlier slices of its group add up to.

    One row per (group, slice): at most slices + groups rows.
    """
    parts = sliced.groupBy(*keys, "_slice").agg(
        *[total.alias(f"_own_{name}") for name, total in totals.items()],
        F.min("_at").alias("_first_at"),
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(k).alias(f"_off_{k}") for k in keys],
        F.col("_slice").alias("_off_slice"),
        "_first_at",
        *[F.coalesce(F.sum(f"_own_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in totals],
    )
    condition = F.col("_slice") == F.col("_off_slice")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_off_{key}"))
    return sliced.join(settled(offsets), condition).drop("_off_slice", *[f"_off_{k}" for k in keys])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "_idx",
    groups: DataFrame | None = None,
    slice_rows: int = MAX_GROUP_ROWS // 4,
) -> DataFrame:
    """Add the 0-based position of a row in its group.

    ``groups`` lists large groups (see ``large_groups``). Without it every group
    is numbered by a plain window.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if groups is None:
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    usual = rows_outside(df, groups, keys)
    usual = usual.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    return usual.unionByName(large_group_positions(df, groups, keys, order, name, slice_rows))


def large_group_positions(
    df: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "_idx",
    slice_rows: int = MAX_GROUP_ROWS // 4,
) -> DataFrame:
    """Positions for the rows of the listed groups, shared by many tasks."""
    sliced = _sorted_slices(rows_of(df, groups, keys), groups, keys, order, slice_rows)
    placed = _with_offsets(sliced, keys, {"n": F.count(F.lit(1))})
    return placed.withColumn(
        name, (F.col("_before_n") + F.col("_at") - F.col("_first_at")).cast("long")
    ).select(*df.columns, name)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    max_group_rows: int | None = MAX_GROUP_ROWS,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add ``_idx`` and, per entry ``name: column``, the total of the rows up to this one.

    ``order`` must be unique inside a group. Large groups add per-slice totals
    to totals inside the slice, so no task sees a whole large group.
    """
    keys = list(keys)
    groups = large_groups(df, keys, max_group_rows)

    def inside(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        so_far = window.rowsBetween(Window.unboundedPreceding, 0)
        return frame.select(
            "*",
            (F.row_number().over(window) - 1).cast("long").alias("_idx"),
            *[F.sum(column).over(so_far).alias(name) for name, column in sums.items()],
        )

    if groups is None:
        return inside(df, keys)
    usual = inside(rows_outside(df, groups, keys), keys)
    sliced = _sorted_slices(
        rows_of(df, groups, keys), groups, keys, order, slice_rows or max(max_group_rows // 4, 1)
    )
    totals = {"n": F.count(F.lit(1)), **{name: F.sum(column) for name, column in sums.items()}}
    local = inside(_with_offsets(sliced, keys, totals), [*keys, "_slice"])
    large = local.select(
        *df.columns,
        (F.col("_idx") + F.col("_before_n")).cast("long").alias("_idx"),
        *[(F.col(name) + F.col(f"_before_{name}")).alias(name) for name in sums],
    )
    return usual.unionByName(large)


def in_chunks(df: DataFrame, size: int, before: int = 0, after: int = 0, name: str = "_idx") -> DataFrame:
    """Spread every group over chunks of ``size`` positions with borrowed neighbours.

    Adds ``_chunk`` and ``_own``. A chunk also gets the last ``before`` rows of
    the previous chunk and the first ``after`` rows of the next one, marked
    ``_own = false``.
    """
    if size < max(before, after):
        raise ValueError("a chunk must be at least as long as what it borrows")
    chunk = F.floor(F.col(name) / F.lit(size)).cast("long")
    at = F.col(name) % size
    targets = [F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own"))]
    if before:
        targets.append(F.when(at >= size - before, F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own"))))
    if after:
        targets.append(
            F.when((at < after) & (chunk > 0), F.struct((chunk - 1).alias("_chunk"), F.lit(False).alias("_own")))
        )
    placed = df.withColumn("_place", F.explode(F.array_compact(F.array(*targets))))
    return placed.select(*df.columns, "_place._chunk", "_place._own")

"""The steps of a study as functions from DataFrames to DataFrames.

Scores that several later steps read are stored first: in the output folder when
one is given, else in the cluster's checkpoint folder. A lost executor then costs
a re-read and not a recomputation of everything before it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlens.models.batches import window_batch
from trajlens.operators import (
    labels,
    lineage,
    metrics,
    preprocess,
    profile as profiles,
    quality,
    sampling,
    scoring,
    temporal,
    thresholds,
    windows as windowing,
)
from trajlens.operators.ordering import MAX_GROUP_ROWS, checkpointed, local_table, once
from trajlens.roles import Roles
from trajlens.sources.metric_files import ENTITY_LEVEL

SPLITS = ("train", "validation", "test")


# --- profile ---------------------------------------------------------------


def profile(
    tables: Mapping[str, DataFrame],
    roles: Roles = Roles(),
    readouts: Sequence[str] = (),
    label_tables: Mapping[str, str] | None = None,
    feature_table: str | None = None,
    max_features: int | None = None,
    cheap: bool = False,
    exact: bool = False,
) -> dict[str, DataFrame]:
    """Report tables about the raw tables, each with a ``source`` column where it covers several.

    ``cheap`` leaves out the counts, missing values, gaps and lengths of the
    tables named in ``readouts``, which are the large ones. ``max_features``
    restricts histograms, box plots and correlations to the first numeric columns; all are the default.
    """
    light = {name: df for name, df in tables.items() if not (cheap and name in readouts)}
    reports: dict[str, DataFrame] = {}

    def tagged(parts: Mapping[str, DataFrame]) -> DataFrame:
        rows = [df.select(F.lit(name).alias("source"), "*") for name, df in parts.items()]
        return reduce(DataFrame.unionByName, rows)

    first = next(iter(tables.values()))
    reports["schema"] = local_table(
        first.sparkSession,
        [(name, i, c, t) for name, df in tables.items() for i, (c, t) in enumerate(df.dtypes)],
        "source string, ordinal int, column string, dtype string",
    )
    if light:
        reports["shape"] = tagged({n: quality.shape(df) for n, df in light.items()})
        reports["missing"] = tagged({n: quality.missing_report(df) for n, df in light.items()})
    series = {n: df for n, df in light.items() if roles.entity in df.columns and roles.time in df.columns}
    lengths = {}  # of the feature table, stored for two reports
    if feature_table is not None:
        lengths[feature_table] = once(temporal.length_per_entity(tables[feature_table], roles.entity))
    if series:
        reports["gaps"] = tagged(
            {n: temporal.gap_report(df, roles.entity, roles.time, exact=exact) for n, df in series.items()}
        )
        reports["lengths"] = tagged(
            {n: temporal.length_report(df, roles.entity, exact=exact, lengths=lengths.get(n)) for n, df in series.items()}
        )
    label_tables = dict(label_tables or {})
    if label_tables:
        labelled = {n: tables[n] for n in label_tables}
        classes = {n: df for n, df in labelled.items() if label_tables[n] == "class_label"}
        if classes:
            reports["classes"] = labels.class_distribution(classes)
        reports["binary"] = labels.binary_distribution(labelled, roles.entity, label_tables)
        reports["label_summary"] = tagged(
            {n: labels.label_summary(df, roles.entity, label_tables[n]) for n, df in labelled.items()}
        )
    if feature_table is not None:
        df = tables[feature_table]
        features = preprocess.numeric_columns(df, roles.non_features, limit=max_features)
        known = profiles.Columns(df, features)
        reports["histograms"] = profiles.histogram(df, features, known=known)
        reports["boxplots"] = profiles.boxplot_stats(df, features, known=known)
        reports["correlation"] = profiles.correlation(df, features, known=known)
        reports["records_per_entity"] = profiles.histogram(lengths[feature_table], ["n_records"])
    return reports


# Columns of reports that say what a row is about; all others are values.
_ABOUT = ("ordinal", "column", "dtype", "class_label", "label_column", "feature", "feature_a", "feature_b", "bin")


def report_rows(reports: Mapping[str, DataFrame]) -> DataFrame:
    """All reports of a profile as one table ``(report, source, key, metric, value)``.

    ``key`` joins what a row is about by a bar. A report without values has the metric ``listed``.
    """
    parts = []
    for name, df in reports.items():
        about = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _ABOUT if c in df.columns]
        values = [c for c in df.columns if c not in (*_ABOUT, "source")]
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values]
        listed = F.struct(F.lit("listed").alias("metric"), F.lit(1.0).alias("value"))
        parts.append(
            df.select(
                F.lit(name).alias("report"),
                (F.col("source") if "source" in df.columns else F.lit(None).cast("string")).alias("source"),
                F.concat_ws("|", *about).alias("key"),
                F.inline(F.array(*(pairs or [listed]))),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# --- prepare ---------------------------------------------------------------


@dataclass(frozen=True)
class PrepareConfig:
    max_entities: int | None = None
    min_positives: int = sampling.MIN_POSITIVES
    repair_col: str = "in_study_repair"
    label_col: str | None = None
    exclude: tuple[str, ...] = ()
    max_missing_ratio: float = preprocess.MAX_MISSING_RATIO
    drop_constant: bool = True
    fill_strategy: str = preprocess.FILL_STRATEGY
    relative_error: float = 0.0
    window_size: int = windowing.WINDOW_SIZE
    stride: int = windowing.STRIDE
    label_policy: str = "vehicle_label"
    files: int | None = None
    dtype: str = "float"
    max_group_rows: int | None = MAX_GROUP_ROWS


@dataclass(frozen=True)
class Manifest:
    """Where a preparation left its fingerprints, and the run and settings they belong to."""

    path: str
    run_name: str
    settings: Mapping[str, object]

    def verify(self, windows: DataFrame, split: str) -> None:
        """Fail unless the windows of a split are those that this run prepared with these settings."""
        lineage.validate_preparation(windows, self.path, self.run_name, f"windows/{split}", self.settings)


@dataclass(frozen=True)
class Prepared:
    """Windows per split, what was fitted, and the fingerprints when windows were written."""

    windows: dict[str, DataFrame]
    fitted: preprocess.FittedPreprocessing
    fingerprints: dict[str, str] = field(default_factory=dict)
    manifest: Manifest | None = None

    def summary(self, entity: str) -> DataFrame:
        return windowing.summary_by_split(self.windows, entity)


def prepare(
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    train_labels: DataFrame,
    validation_labels: DataFrame,
    test_labels: DataFrame,
    roles: Roles = Roles(),
    config: PrepareConfig = PrepareConfig(),
    out_dir: str | None = None,
    run_name: str = "full",
) -> Prepared:
    """Pick entities, label, fit on train, scale all splits and cut them into windows."""
    entity, n = roles.entity, config.max_entities
    if n is None:
        normal = labels.keep_normal(train, train_labels, entity, config.repair_col)
    else:
        ids = sampling.normal_entities(train_labels, entity, n, config.repair_col)
        normal = sampling.restrict(train, ids, entity)
    working = {"train": normal}
    for split, df, known in (("validation", validation, validation_labels), ("test", test, test_labels)):
        if n is not None:
            ids = sampling.stratified_entities(known, entity, n, config.min_positives, config.label_col)
            df = sampling.restrict(df, ids, entity)
        working[split] = labels.attach_labels(df, known, entity, config.label_col, roles.label)
    if out_dir is not None:
        working = {s: _stored(df, f"{out_dir}/working/{s}") for s, df in working.items()}

    fitted = preprocess.fit(
        working["train"],
        roles=roles,
        exclude=config.exclude,
        max_missing_ratio=config.max_missing_ratio,
        drop_constant=config.drop_constant,
        strategy=config.fill_strategy,
        relative_error=config.relative_error,
        max_group_rows=config.max_group_rows,
    )
    windows = {}
    for split in SPLITS:
        scaled = preprocess.apply(working[split], fitted, roles, config.dtype)
        windows[split] = windowing.build_windows(
            scaled,
            fitted.scaled_columns,
            entity,
            roles.time,
            roles.label,
            config.window_size,
            config.stride,
            config.label_policy,
            config.dtype,
            config.max_group_rows,
        )
    if out_dir is None:
        return Prepared(windows, fitted)
    spark = train.sparkSession
    fingerprints = {}
    for split, df in windows.items():
        path = f"{out_dir}/windows/{split}"
        stored = windowing.store_windows(df, path, entity, config.files, fitted.source_columns)
        windows[split] = windowing.read_windows(spark, path)
        fingerprints[split] = lineage.write_preparation(
            windows[split], f"{out_dir}/manifest", run_name, f"windows/{split}", asdict(config),
            (stored.n_windows, stored.content_hash),
        )
    fitted.parameters(spark).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/parameters")
    return Prepared(windows, fitted, fingerprints, Manifest(f"{out_dir}/manifest", run_name, asdict(config)))


def _stored(df: DataFrame, path: str | None) -> DataFrame:
    """Written to the path and read back, or checkpointed when there is no path."""
    if path is None:
        return checkpointed(df)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _below(out_dir: str | None, *parts: str) -> str | None:
    return None if out_dir is None else "/".join([out_dir.rstrip("/"), *parts])


# --- fit, threshold, evaluate ----------------------------------------------


def score_models(windows: DataFrame, models: Mapping[str, object], entity: str, seconds: bool = False) -> DataFrame:
    """``(model, window_id, entity, …, outlier_score)`` of several models from one pass over the windows.

    With ``seconds``, a last column of that name holds each row's share of the time that its model took for its batch.
    """
    kept = ["window_id", entity, "start_time_step", "end_time_step", "y_true"]
    fields = [T.StructField("model", T.StringType())] + [windows.schema[c] for c in kept]
    added = [scoring.SCORE, *(["seconds"] if seconds else [])]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    fitted = dict(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = window_batch(batch)
            for name, model in fitted.items():
                start = time.perf_counter()
                scores = ((x - model.reconstruct(x)) ** 2).mean(axis=(1, 2)) if len(x) else np.empty(0)
                share = np.full(len(x), (time.perf_counter() - start) / max(len(x), 1))
                columns = [pa.array([name] * len(x), type=pa.string()), *[batch.column(c) for c in kept]]
                columns += [pa.array(v, type=pa.float64()) for v in (scores, share)[: len(added)]]
                yield pa.RecordBatch.from_arrays(columns, names=["model", *kept, *added])

    scored = windows.select(*kept, "X").mapInArrow(work, schema)
    return scored.withColumn("y_true", F.coalesce("y_true", F.lit(labels.UNLABELLED)))


def _check_score(score_col: str) -> None:
    if score_col in ("any_outlier", "outlier_window_ratio"):
        raise ValueError(f"{score_col} is undefined before a threshold exists, so it cannot select one")


def fit_and_threshold(
    models: Mapping[str, object],
    validation_windows: DataFrame,
    entity: str,
    score_col: str = "max_score",
    strategy: str = thresholds.BEST_F1,
    percent: float = thresholds.PERCENTILE,
    training_seconds: Mapping[str, float] | None = None,
    train_windows: DataFrame | None = None,
    out_dir: str | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    manifest: Manifest | None = None,
) -> tuple[dict[str, object], DataFrame]:
    """Fitted models and ``(model, threshold, score_col, selection_split, selection_level, training_time_seconds)``.

    A model is a fitted object or a function of the train windows. Thresholds
    are chosen on entity scores of the validation windows. With a manifest, both
    window tables are verified before anything is fitted.
    """
    _check_score(score_col)
    if manifest is not None:
        manifest.verify(validation_windows, "validation")
        if train_windows is not None:
            manifest.verify(train_windows, "train")
    seconds = dict(training_seconds or {})
    if sum(not hasattr(model, "reconstruct") for model in models.values()) > 1:
        train_windows = once(train_windows)  # every fit reads them at least once
    fitted: dict[str, object] = {}
    for name, model in models.items():
        if hasattr(model, "reconstruct"):
            fitted[name] = model
            continue
        start = time.time()
        fitted[name] = model(train_windows)
        seconds[name] = round(time.time() - start, 3)
    scored = _stored(score_models(validation_windows, fitted, entity), _below(out_dir, "scores", "validation"))
    rolled = scoring.aggregate_entities(scored, entity, by=["model"], max_group_rows=max_group_rows)
    chosen = thresholds.select(
        rolled, score_col, strategy=strategy, percent=percent, by=["model"], max_group_rows=max_group_rows
    )
    chosen = checkpointed(chosen)  # one row per model, used by every later step
    times = local_table(
        validation_windows.sparkSession, [(n, seconds.get(n)) for n in fitted], "model string, training_time_seconds double"
    )
    table = chosen.join(F.broadcast(times), "model").select(
        "model",
        "threshold",
        F.lit(score_col).alias("score_col"),
        F.lit("validation").alias("selection_split"),
        F.lit(ENTITY_LEVEL).alias("selection_level"),
        "training_time_seconds",
    )
    return fitted, table


@dataclass(frozen=True)
class Evaluation:
    """Window predictions, entity predictions, metrics per model and window score summary."""

    window_predictions: DataFrame
    entity_predictions: DataFrame
    metrics: DataFrame
    window_summary: DataFrame


def evaluate(
    models: Mapping[str, object],
    limits: DataFrame,
    windows: DataFrame,
    entity: str,
    split: str = "test",
    score_col: str = "max_score",
    min_windows: int = 1,
    out_dir: str | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    manifest: Manifest | None = None,
) -> Evaluation:
    """Score a split, flag windows and entities by each model's threshold, and measure entities.

    One pass over the windows scores all models; later steps read the stored
    scores. A model's inference time is the sum over all tasks of what its
    reconstruction took. With a manifest, the windows are verified first.
    """
    _check_score(score_col)
    if manifest is not None:
        manifest.verify(windows, split)
    timed = _stored(score_models(windows, models, entity, seconds=True), _below(out_dir, "scores", split))
    scored = timed.drop("seconds")
    flagged = scoring.classify(scored, thresholds=limits, by=["model"])
    rolled = scoring.aggregate_entities(
        flagged, entity, by=["model"], min_windows=min_windows, max_group_rows=max_group_rows
    )
    entities = checkpointed(scoring.classify(rolled, thresholds=limits, by=["model"], score=score_col))
    counts = metrics.binary_metrics(entities, by=["model"])
    ranking = metrics.ranking_metrics(entities, score_col, by=["model"], max_group_rows=max_group_rows)
    times = timed.groupBy("model").agg(F.round(F.sum("seconds"), 3).alias("inference_time_seconds"))
    # One row per model on every side.
    table = (
        counts.join(ranking, "model", "left")
        .join(limits.select("model", "threshold", "training_time_seconds"), "model", "left")
        .join(times, "model", "left")
        .withColumn("split", F.lit(split))
        .withColumn("level", F.lit(ENTITY_LEVEL))
    )
    summary = scoring.window_summary(scored, entity, by=["model"], max_group_rows=max_group_rows).withColumn(
        "split", F.lit(split)
    )
    return Evaluation(flagged, entities, table, summary)

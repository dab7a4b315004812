"""Feature choice, imputation and scaling, fitted on the training split only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlens.functions.expressions import safe_numeric
from trajlens.operators.ordering import MAX_GROUP_ROWS, local_table
from trajlens.operators.quality import WIDE_COLUMNS, missing_report, numeric_moments
from trajlens.operators.quantiles import column_ranks, exact_percentiles
from trajlens.roles import Roles

# Defaults of the preparation.
MAX_MISSING_RATIO = 0.8
FILL_STRATEGY = "median"
OUTPUT_PREFIX = "x"

PARAMETER_SCHEMA = "feature string, scaled_name string, imputation_value double, mean double, std double"
REASON_SCHEMA = "feature string, reason string"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (), limit: int | None = None) -> list[str]:
    """Numeric columns in table order, without the excluded ones; ``limit`` keeps the first few."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]
    return names if limit is None else names[:limit]


def sparse_columns(report: DataFrame, max_missing_ratio: float = MAX_MISSING_RATIO) -> list[str]:
    """Columns whose missing ratio is strictly above the limit, in report order."""
    return [r["column"] for r in report.where(F.col("missing_ratio") > max_missing_ratio).collect()]


def drop_sparse_columns(
    df: DataFrame, report: DataFrame | None = None, max_missing_ratio: float = MAX_MISSING_RATIO
) -> DataFrame:
    return df.drop(*sparse_columns(report if report is not None else missing_report(df), max_missing_ratio))


@dataclass(frozen=True)
class FittedFeature:
    feature: str
    imputation_value: float
    mean: float
    std: float


@dataclass(frozen=True)
class FittedPreprocessing:
    """What was learned from the training split; size is bounded by the number of columns."""

    features: tuple[FittedFeature, ...]
    dropped: tuple[tuple[str, str], ...] = field(default=())
    prefix: str = OUTPUT_PREFIX

    @property
    def source_columns(self) -> list[str]:
        return [f.feature for f in self.features]

    @property
    def scaled_columns(self) -> list[str]:
        return [f"{self.prefix}_{i}" for i in range(len(self.features))]

    def parameters(self, spark: SparkSession) -> DataFrame:
        """One row per feature: ``(feature, scaled_name, imputation_value, mean, std)``."""
        rows = [
            (f.feature, name, f.imputation_value, f.mean, f.std) for f, name in zip(self.features, self.scaled_columns)
        ]
        return local_table(spark, rows, PARAMETER_SCHEMA)

    def dropped_features(self, spark: SparkSession) -> DataFrame:
        """One row per (feature, reason); a feature can be dropped for both reasons."""
        return local_table(spark, self.dropped, REASON_SCHEMA)

    @classmethod
    def from_parameters(cls, parameters: DataFrame, prefix: str = OUTPUT_PREFIX) -> "FittedPreprocessing":
        rows = sorted(parameters.collect(), key=lambda r: int(r["scaled_name"].rsplit("_", 1)[1]))
        return cls(
            tuple(FittedFeature(r["feature"], r["imputation_value"], r["mean"], r["std"]) for r in rows), prefix=prefix
        )


def select_features(
    df: DataFrame,
    features: Sequence[str],
    max_missing_ratio: float = MAX_MISSING_RATIO,
    drop_constant: bool = True,
    moments: DataFrame | None = None,
) -> DataFrame:
    """``(ordinal, feature, selected, sparse, constant)`` in the given order, from one pass."""
    stats = moments if moments is not None else numeric_moments(df, features)
    missing_ratio = (F.col("n_rows") - F.col("n_values")) / F.greatest(F.col("n_rows"), F.lit(1))
    flat = (F.col("n_values") == 0) | (F.col("low") == F.col("high"))
    sparse = missing_ratio > max_missing_ratio
    constant = flat if drop_constant else F.lit(False)
    return stats.select(
        "ordinal",
        F.col("column").alias("feature"),
        (~(sparse | constant)).alias("selected"),
        sparse.alias("sparse"),
        constant.alias("constant"),
    ).orderBy("ordinal")


def selection_summary(selection: DataFrame) -> DataFrame:
    """``(reason, count)`` for selected, missing_ratio and constant."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("selected"), F.lit("selected")),
            F.when(F.col("sparse"), F.lit("missing_ratio")),
            F.when(F.col("constant"), F.lit("constant")),
        )
    )
    return selection.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def medians(
    df: DataFrame,
    columns: Sequence[str],
    relative_error: float = 0.0,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> dict[str, float | None]:
    """Median element per column with null and NaN left out; exact when the error is 0."""
    columns = list(columns)
    if relative_error > 0:
        numbers = df.select(*[safe_numeric(c).alias(f"c{i}") for i, c in enumerate(columns)])
        found = numbers.approxQuantile(numbers.columns, [0.5], float(relative_error))
        return {c: (q[0] if q else None) for c, q in zip(columns, found)}
    cells = df.select(F.posexplode(F.array(*[safe_numeric(c) for c in columns])).alias("ordinal", "value"))
    rows = exact_percentiles(
        cells, ["ordinal"], "value", {"median": 0.5}, discrete=True, max_group_rows=max_group_rows, store=False
    ).collect()
    by_ordinal = {r["ordinal"]: r["median"] for r in rows}
    return {c: by_ordinal.get(i) for i, c in enumerate(columns)}


def _fill_values(df, columns, strategy, relative_error, moments, max_group_rows) -> dict[str, float]:
    strategy = strategy.lower()
    if not columns:
        return {}
    if strategy == "median":
        if moments is not None and max_group_rows is not None:
            # The first pass counted the values, so they need not be counted again.
            known = {r["column"]: r["n_values"] for r in moments}
            large = max(known.values()) > max_group_rows
            if large and relative_error <= 0 and len(columns) < WIDE_COLUMNS:
                # the median element, as in ``medians``
                middle = {c: max(-(-known[c] // 2) - 1, 0) for c in columns}
                found = column_ranks(df, {c: (safe_numeric(c), known[c], [middle[c]]) for c in columns})
                return {c: float(found[c].get(middle[c]) or 0.0) for c in columns}
            max_group_rows = max_group_rows if large else None
        found = medians(df, columns, relative_error, max_group_rows)
    elif strategy in ("mean", "average"):
        rows = moments if moments is not None else numeric_moments(df, columns).collect()
        found = {r["column"]: r["mean"] for r in rows}
    elif strategy in ("zero", "constant"):
        found = {}
    else:
        raise ValueError(f"unsupported fill strategy: {strategy}")
    return {c: float(found.get(c) or 0.0) for c in columns}


def fit_imputation(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = FILL_STRATEGY,
    relative_error: float = 0.0,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``(feature, imputation_value)``; 0.0 for a column without values."""
    fills = _fill_values(df, list(columns), strategy, relative_error, None, max_group_rows)
    return local_table(df.sparkSession, list(fills.items()), "feature string, imputation_value double")


def _scale(row, fill: float) -> tuple[float, float]:
    """Mean and population std of a column after its missing values became ``fill``.

    The filled cells are a second group with variance 0, so both groups can be
    merged from their counts and moments; the data need not be read again.
    """
    n, known = row["n_rows"], row["n_values"]
    if n == 0:
        return 0.0, 1.0
    missing = n - known
    mean, variance = row["mean"] or 0.0, row["variance"] or 0.0
    if known == 0:
        return fill, 1.0
    shift = fill - mean
    merged_mean = mean + shift * missing / n
    merged_variance = (variance * known + shift * shift * known * missing / n) / n
    std = merged_variance**0.5
    return merged_mean, std if std > 0.0 else 1.0


def fit_scaling(df: DataFrame, columns: Sequence[str], fills: dict[str, float]) -> DataFrame:
    """``(feature, mean, std)`` after imputation; a std of 0 becomes 1."""
    rows = [(r["column"], *_scale(r, fills.get(r["column"], 0.0))) for r in numeric_moments(df, columns).collect()]
    return local_table(df.sparkSession, rows, "feature string, mean double, std double")


def fit(
    train: DataFrame,
    features: Sequence[str] | None = None,
    roles: Roles = Roles(),
    exclude: Sequence[str] = (),
    max_missing_ratio: float = MAX_MISSING_RATIO,
    drop_constant: bool = True,
    strategy: str = FILL_STRATEGY,
    relative_error: float = 0.0,
    prefix: str = OUTPUT_PREFIX,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> FittedPreprocessing:
    """Learn feature choice, fill values and scaling from the training split.

    One pass gives counts, ranges and moments of all features; the median adds
    its own passes. Mean and std after imputation follow from the moments.
    """
    if features is None:
        features = numeric_columns(train, [*roles.non_features, *exclude])
    features = list(features)
    if not features:
        return FittedPreprocessing((), (), prefix)
    moments = numeric_moments(train, features).collect()
    sparse, constant = [], []
    for row in moments:
        if (row["n_rows"] - row["n_values"]) / max(row["n_rows"], 1) > max_missing_ratio:
            sparse.append(row["column"])
        if drop_constant and (row["n_values"] == 0 or row["low"] == row["high"]):
            constant.append(row["column"])
    selected = [c for c in features if c not in {*sparse, *constant}]
    fills = _fill_values(train, selected, strategy, relative_error, moments, max_group_rows)
    by_name = {row["column"]: row for row in moments}
    fitted = tuple(FittedFeature(c, fills[c], *_scale(by_name[c], fills[c])) for c in selected)
    dropped = tuple((c, "missing_ratio") for c in sparse) + tuple((c, "constant") for c in constant)
    return FittedPreprocessing(fitted, dropped, prefix)


def apply(
    df: DataFrame,
    fitted: FittedPreprocessing | DataFrame,
    roles: Roles = Roles(),
    dtype: str = "float",
) -> DataFrame:
    """``(entity, time, [label], x_0 … x_{n-1})``: filled and scaled in one projection."""
    if isinstance(fitted, DataFrame):
        fitted = FittedPreprocessing.from_parameters(fitted)
    label = [F.col(roles.label).cast("int").alias(roles.label)] if roles.label in df.columns else []
    scaled = [
        ((safe_numeric(f.feature, f.imputation_value) - F.lit(f.mean)) / F.lit(f.std)).cast(dtype).alias(name)
        for f, name in zip(fitted.features, fitted.scaled_columns)
    ]
    return df.select(roles.entity, roles.time, *label, *scaled)

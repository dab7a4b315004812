"""Histograms, box-plot statistics and correlations on the full data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions.expressions import even_bin, is_finite
from trajlens.operators.ordering import MAX_GROUP_ROWS, beside, local_table, once
from trajlens.operators.quality import WIDE_COLUMNS
from trajlens.operators.quantiles import column_ranks, exact_percentiles

# Bins, whisker length in interquartile ranges.
BINS = 30
WHISKER = 1.5
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by…, feature, value)`` of all finite values."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*by, F.inline(pairs)).where(is_finite(F.col("value")))


class Columns:
    """The finite values of columns side by side, and what several reports ask about them, each looked up once.

    A pass reads whole rows and takes all columns along: no cell is exploded, joined or stored. What is not
    stored yet, as a join, is computed once.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.names = list(columns)
        self._at = {c: f"c{i}" for i, c in enumerate(self.names)}
        number = {c: F.col(c).cast("double") for c in self.names}
        self.values = once(df.select(*[F.when(is_finite(number[c]), number[c]).alias(at) for c, at in self._at.items()]))
        self._found: dict[str, dict[int, float]] = {c: {} for c in self.names}

    def __getitem__(self, name: str) -> Column:
        return F.col(self._at[name])

    @cached_property
    def _ranges(self):
        facts = [F.struct(F.count(self[c]), F.min(self[c]), F.max(self[c])).alias(at) for c, at in self._at.items()]
        return self.values.agg(F.count(F.lit(1)).alias("n"), *facts).first()

    @property
    def n_rows(self) -> int:
        return self._ranges["n"]

    @property
    def ranges(self) -> dict[str, tuple[int, float | None, float | None]]:
        """``column: (how many values, minimum, maximum)``."""
        return {c: tuple(self._ranges[at]) for c, at in self._at.items()}

    def percentiles(self, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list[float]]:
        """Interpolated percentiles of columns that have values."""
        ranges = self.ranges
        places = {c: [(ranges[c][0] - 1) * f for f in fractions] for c in columns}
        sides = {c: [(math.floor(p), min(math.floor(p) + 1, ranges[c][0] - 1)) for p in places[c]] for c in columns}
        unknown = {c: {rank for pair in sides[c] for rank in pair} - set(self._found[c]) for c in columns}
        for c, ranks in column_ranks(self.values, {c: (self[c], ranges[c][0], unknown[c]) for c in columns}).items():
            self._found[c] |= ranks

        def between(c: str, place: float, left: int, right: int) -> float:
            a, b, weight = self._found[c][left], self._found[c][right], place - left
            return a if a == b else (1.0 - weight) * a + weight * b

        return {c: [between(c, p, *pair) for p, pair in zip(places[c], sides[c])] for c in columns}


def _histogram_of_columns(known: Columns, bins: int) -> DataFrame:
    """Bins of whole columns: their numbers are counted per task, and at most ``bins`` rows per column go to the driver."""
    filled = {c: (low, high) for c, (n, low, high) in known.ranges.items() if n}
    ends = {c: (low - 0.5, high + 0.5) if low == high else (low, high) for c, (low, high) in filled.items()}
    places = [
        F.when(known[c].isNotNull(), even_bin(known[c], F.lit(low), F.lit(high), bins) + F.lit(i * bins))
        for i, (c, (low, high)) in enumerate(ends.items())
    ]
    counts = {}
    if places:
        placed = known.values.select(F.explode(F.array(*places)).alias("place")).where("place IS NOT NULL")
        counts = dict(map(tuple, placed.groupBy("place").agg(F.count(F.lit(1))).collect()))
    found = []
    for i, (c, (low, high)) in enumerate(ends.items()):
        step = (high - low) / float(bins)
        for b in range(bins):
            upper = high if b == bins - 1 else low + (b + 1) * step
            found.append((c, b, low + b * step, upper, counts.get(i * bins + b, 0)))
    return local_table(
        known.values.sparkSession, found, "feature string, bin int, low double, high double, count long"
    )


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = BINS, by: Sequence[str] = (), known: Columns | None = None
) -> DataFrame:
    """``(by…, feature, bin, low, high, count)`` over equal bins from minimum to maximum.

    The last bin is closed, empty bins are kept, and a single value gets the
    range value ± 0.5. Counts are combined before the shuffle, so at most
    ``bins`` rows per group and task are exchanged. ``known`` are the columns, where other reports look them up too.
    """
    if not by and len(columns) < WIDE_COLUMNS:
        return _histogram_of_columns(known or Columns(df, columns), bins)
    keys = [*by, "feature"]
    cells = _cells(df, columns, by)
    ranges = cells.groupBy(*keys).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.select(
        *keys,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_low"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_high"),
    )
    low, high = F.col("_low"), F.col("_high")
    placed = beside(cells, ranges, keys).select(*keys, even_bin(F.col("value"), low, high, bins).alias("bin"))
    counted = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    empty = ranges.select(*keys, "_low", "_high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (high - low) / float(bins)
    return beside(empty, counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (low + F.col("bin") * step).alias("low"),
        F.when(F.col("bin") == bins - 1, high).otherwise(low + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _boxplots_of_columns(known: Columns) -> DataFrame:
    """Box plots of whole columns: quartiles by ranks of all columns, whiskers in one pass."""
    ranges = known.ranges
    filled = [c for c in known.names if ranges[c][0]]
    boxes, ends = known.percentiles(filled, list(QUARTILES.values())), {}
    for c, (q1, _, q3) in boxes.items():
        reach, value = WHISKER * (q3 - q1), known[c]
        ends[c] = F.array(F.min(F.when(value >= q1 - reach, value)), F.max(F.when(value <= q3 + reach, value)))
    row = known.values.agg(*ends.values()).first() if ends else ()
    found = []
    for (c, (q1, median, q3)), (low, high) in zip(boxes.items(), row):
        # A whisker never ends inside the box.
        low, high = (q1 if low is None else min(low, q1)), (q3 if high is None else max(high, q3))
        found.append((c, q1, median, q3, low, high, ranges[c][0]))
    numbers = [f"{name} double" for name in (*QUARTILES, "whisker_low", "whisker_high")]
    return local_table(known.values.sparkSession, found, ", ".join(["feature string", *numbers, "n long"]))


def boxplot_stats(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    max_group_rows: int | None = MAX_GROUP_ROWS,
    known: Columns | None = None,
) -> DataFrame:
    """``(by…, feature, q1, median, q3, whisker_low, whisker_high, n)``.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the box. ``known`` as for ``histogram``;
    ``max_group_rows`` is for groups.
    """
    if not by and len(columns) < WIDE_COLUMNS:
        return _boxplots_of_columns(known or Columns(df, columns))
    keys = [*by, "feature"]
    cells = _cells(df, columns, by)
    quartiles = exact_percentiles(cells, keys, "value", QUARTILES, max_group_rows=max_group_rows)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    value = F.col("value")
    inside_low = F.when(value >= F.col("q1") - reach, value)
    inside_high = F.when(value <= F.col("q3") + reach, value)
    found = beside(cells, quartiles, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(inside_low).alias("_low"), F.max(inside_high).alias("_high"), F.count(F.lit(1)).alias("n")
    )
    # A whisker never ends inside the box.
    return found.select(
        *keys,
        "q1",
        "median",
        "q3",
        F.least(F.coalesce("_low", "q1"), "q1").alias("whisker_low"),
        F.greatest(F.coalesce("_high", "q3"), "q3").alias("whisker_high"),
        "n",
    )


def correlation(
    df: DataFrame, columns: Sequence[str], max_group_rows: int | None = MAX_GROUP_ROWS, known: Columns | None = None
) -> DataFrame:
    """``(feature_a, feature_b, correlation)``: Pearson, missing values filled with the median.

    Features need at least three finite values that differ; with fewer than two
    such features there is no row. One pass over assembled vectors gives the whole
    matrix, whose size depends on the number of columns alone. What is not stored yet, as a join, is
    computed once, and medians only for features that miss a value. ``known`` as for ``histogram``.
    """
    known = known or Columns(df, columns)
    ranges = known.ranges
    usable = [c for c, (n, low, high) in ranges.items() if n >= 3 and low < high]
    schema = "feature_a string, feature_b string, correlation double"
    if len(usable) < 2:
        return df.sparkSession.createDataFrame([], schema)
    holed = [c for c in usable if ranges[c][0] < known.n_rows]
    if len(holed) < WIDE_COLUMNS:
        fills = {c: median for c, (median,) in known.percentiles(holed, [0.5]).items()}
    else:
        cells = _cells(known.values.select(*[known[c].alias(c) for c in holed]), holed, ())
        medians = exact_percentiles(cells, ["feature"], "value", {"median": 0.5}, max_group_rows=max_group_rows, store=False)
        fills = {r["feature"]: r["median"] for r in medians.collect()}
    vector = array_to_vector(F.array(*[F.coalesce(known[c], F.lit(fills.get(c))) for c in usable])).alias("features")
    matrix = Correlation.corr(known.values.select(vector), "features").first()[0].toArray()
    pairs = [
        (a, b, 1.0 if a == b else float(matrix[i, j])) for i, a in enumerate(usable) for j, b in enumerate(usable)
    ]
    return local_table(df.sparkSession, pairs, schema)

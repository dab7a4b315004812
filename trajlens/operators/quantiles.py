"""Exact percentiles of groups of any size.

Groups of ordinary size are sorted once as an array, and every percentile is
read from it by position; this is several times faster than the built-in
``percentile``, which keeps a map of boxed values per percentile. Groups above
the limit are narrowed instead: a small sketch proposes a bracket, exact counts
place the wanted rank inside or outside of it, and the rows left in the bracket
are looked at again until few remain. The sketch only steers; the counts decide,
so the result does not depend on its error.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.operators.ordering import (
    MAX_GROUP_ROWS,
    large_groups,
    rows_of,
    rows_outside,
    settled,
)

# Probes of one sketch pass; each pass leaves about 1/PROBES of the rows.
PROBES = 500
# Rows of one bracket that are sorted directly.
DIRECT_ROWS = 50_000
# Shares of a group, where brackets are joined by shuffle.
SALTS = 32


def sorted_values(value: str) -> Column:
    """Aggregate: the values of a group of bounded size in ascending order."""
    return F.sort_array(F.collect_list(value))


def percentile_of(values: str, fraction: float, discrete: bool = False) -> Column:
    """Percentile of a sorted array: interpolated, or the first value that reaches the fraction."""
    n = F.size(values)
    if discrete:
        return F.get(values, F.greatest(F.ceil(n * F.lit(float(fraction))).cast("int") - 1, F.lit(0)))
    place = (n - 1) * F.lit(float(fraction))
    at = F.floor(place).cast("int")
    low, high, weight = F.get(values, at), F.get(values, F.least(at + 1, n - 1)), place - at
    return F.when(low == high, low).otherwise((F.lit(1.0) - weight) * low + weight * high)


def exact_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    discrete: bool = False,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    store: bool = True,
) -> DataFrame:
    """``(by…, one column per fraction)``; null and NaN values are left out.

    ``store=False`` scans ``df`` again in every narrowing pass instead of
    storing the values of the large groups; right for a plain table scan.
    ``max_group_rows=None`` is for callers who know that no group is large.
    """
    by = list(by)
    number = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    values = df.select(*by, number.alias("_value")).where(F.col("_value").isNotNull())
    groups = large_groups(values, by, max_group_rows)

    def direct(rows: DataFrame) -> DataFrame:
        arrays = rows.groupBy(*by).agg(sorted_values("_value").alias("_sorted"))
        return arrays.select(*by, *[percentile_of("_sorted", f, discrete).alias(name) for name, f in fractions.items()])

    if groups is None:
        return direct(values)
    large = rows_of(values, groups, by)
    narrowed = _narrow(settled(large) if store else large, groups, by, fractions, discrete)
    if not by:
        return narrowed
    return direct(rows_outside(values, groups, by)).unionByName(narrowed)


def column_ranks(
    df: DataFrame, wanted: Mapping[str, tuple[Column, int, Collection[int]]]
) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks per column: ``name: (numbers or null, how many there are, ranks)``.

    Narrowed as in ``exact_percentiles``, with all columns side by side in each pass: no cell is exploded, joined or
    shuffled, and the brackets of the few columns are literals. Ranks in one bracket are looked up together.
    """
    value = {name: number for name, (number, _, _) in wanted.items()}
    found: dict[str, dict[int, float]] = {name: {} for name in wanted}
    # (column, low, high, how many lie below the bracket, how many inside): ranks inside
    state = {(name, None, None, 0, n): [r for r in ranks if 0 <= r < n] for name, (_, n, ranks) in wanted.items()}
    state = {bracket: ranks for bracket, ranks in state.items() if ranks}
    fractions = [i / PROBES for i in range(PROBES + 1)]
    while state:
        looks = []
        for (name, low, high, below, n), ranks in state.items():
            inside = value[name] if low is None else F.when(value[name] > F.lit(low), value[name])
            inside = inside if high is None else F.when(value[name] < F.lit(high), inside)
            if n <= DIRECT_ROWS:
                looks.append(F.array(*[F.get(sorted_values(inside), F.lit(rank - below)) for rank in ranks]))
            else:
                looks.append(F.percentile_approx(inside, fractions, 4 * PROBES))
        stretches: dict[tuple, list[int]] = {}
        for (bracket, ranks), seen in zip(state.items(), df.agg(*[x.alias(f"_{i}") for i, x in enumerate(looks)]).first()):
            name, _, _, below, n = bracket
            if n <= DIRECT_ROWS:
                found[name].update(zip(ranks, seen))
                continue
            for rank in ranks:
                place = (rank - below) / max(n - 1, 1) * PROBES
                ends = {seen[max(int(place) - 1, 0)], seen[min(int(-(-place // 1)) + 1, PROBES)]}
                stretches.setdefault((bracket, tuple(sorted(ends))), []).append(rank)
        if not stretches:
            break
        points = list(dict.fromkeys((bracket[0], x) for bracket, ends in stretches for x in ends))
        counts = [
            F.array(F.count_if(value[name] < F.lit(x)), F.count_if(value[name] <= F.lit(x))).alias(f"_{i}")
            for i, (name, x) in enumerate(points)
        ]
        counted, state = dict(zip(points, df.agg(*counts).first())), {}
        for ((name, low, high, below, n), ends), ranks in stretches.items():
            parts, start = [], below
            for x in ends:
                before, upto = counted[name, x]
                parts += [((low, x, start, before - start), before, None), (None, upto, x)]
                low, start = x, upto
            parts.append(((low, high, start, below + n - start), below + n, None))
            if [part[1] for part in parts] != sorted([below, *[part[1] for part in parts]])[1:]:
                raise RuntimeError(f"the values of {name} changed between two passes")
            for rank in ranks:
                bounds, _, hit = next(part for part in parts if rank < part[1])
                if bounds is None:
                    found[name][rank] = hit
                else:
                    state.setdefault((name, *bounds), []).append(rank)
    return found


def _wanted(groups: DataFrame, by: Sequence[str], fractions: Mapping[str, float], discrete: bool) -> DataFrame:
    """``(by…, _n, _name, _left, _right, _weight)``: the two 0-based ranks of each percentile and the weight of the right one."""
    n = F.col("_group_rows")
    wanted = []
    for name, fraction in fractions.items():
        if discrete:
            left = F.greatest(F.ceil(n * F.lit(float(fraction))).cast("long") - 1, F.lit(0).cast("long"))
            right, weight = left, F.lit(0.0)
        else:
            place = (n - 1) * F.lit(float(fraction))
            left = F.floor(place).cast("long")
            right, weight = F.least(left + 1, n - 1), place - left
        wanted.append(
            F.struct(
                F.lit(name).alias("_name"), left.alias("_left"), right.alias("_right"), weight.cast("double").alias("_weight")
            )
        )
    return groups.select(*by, n.alias("_n"), F.inline(F.array(*wanted)))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join; the keys of the right side are dropped."""
    renamed = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = F.col(key).eqNullSafe(F.col(f"_other_{key}")) & condition
    return left.join(renamed, condition, how).drop(*[f"_other_{k}" for k in keys])


def _inside(values: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every value with each bracket of its group that holds it.

    Both sides carry a salt, so that a large group is shared by many tasks where
    Spark joins by shuffle.
    """
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = brackets.withColumn("_salt", F.explode(salts))
    placed = values.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = _same(placed, dealt, [*by, "_salt"]).drop("_salt")
    value, low, high = F.col("_value"), F.col("_low"), F.col("_high")
    return joined.where((low.isNull() | (value > low)) & (high.isNull() | (value < high)))


def _narrow(df: DataFrame, groups: DataFrame, by: list[str], fractions: Mapping[str, float], discrete: bool) -> DataFrame:
    """Percentiles of the listed groups.

    The state is a table with one row per group and wanted rank: the open bracket
    that holds it, how many rows lie below and inside, or the value once it is
    found. Every round narrows all of them by joins; the driver sees only how many are open.
    """
    keys = by or ["_all"]
    if not by:
        df, groups = (t.withColumn("_all", F.lit(0)) for t in (df, groups))
    wanted = _wanted(groups, keys, fractions, discrete)
    ranks = wanted.select(*keys, "_n", F.explode(F.array("_left", "_right")).alias("_rank")).distinct()
    none = F.lit(None).cast("double")
    state = settled(
        ranks.select(
            *keys, "_rank", none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below"),
            F.col("_n").alias("_rows"), none.alias("_found"),
        )
    )
    while not (still := state.where("_found IS NULL")).isEmpty():
        done = state.where("_found IS NOT NULL")
        few = F.col("_rows") <= DIRECT_ROWS
        state = settled(
            done.unionByName(_look_up(df, still.where(few), keys)).unionByName(_split(df, still.where(~few), keys))
        )
    values = state.select(*keys, "_rank", "_found")
    left = _same(wanted.withColumnRenamed("_left", "_rank"), values, [*keys, "_rank"]).withColumnRenamed("_found", "_a")
    both = _same(left.drop("_rank").withColumnRenamed("_right", "_rank"), values, [*keys, "_rank"])
    a, b, weight = F.col("_a"), F.col("_found"), F.col("_weight")
    value = F.when(a == b, a).otherwise((F.lit(1.0) - weight) * a + weight * b)
    named = [F.max(F.when(F.col("_name") == name, value)).alias(name) for name in fractions]
    return both.groupBy(*keys).agg(*named).select(*by, *fractions)


def _look_up(df: DataFrame, still: DataFrame, keys: list[str]) -> DataFrame:
    """Sort the few rows of each bracket and read the wanted ranks."""
    bracket = [*keys, "_low", "_high"]
    arrays = _inside(df, still.select(*bracket).distinct(), keys).groupBy(*bracket).agg(
        sorted_values("_value").alias("_sorted")
    )
    found = F.get("_sorted", (F.col("_rank") - F.col("_below")).cast("int"))
    return _same(still.drop("_found"), arrays, bracket).select(
        *keys, "_rank", "_low", "_high", "_below", "_rows", found.alias("_found")
    )


def _split(df: DataFrame, still: DataFrame, keys: list[str]) -> DataFrame:
    """Propose a narrower bracket for every rank and let exact counts decide."""
    bracket = [*keys, "_low", "_high"]
    fractions = [i / PROBES for i in range(PROBES + 1)]
    sketches = _inside(df, still.select(*bracket).distinct(), keys).groupBy(*bracket).agg(
        F.percentile_approx("_value", fractions, 4 * PROBES).alias("_probes")
    )
    inside = F.col("_rank") - F.col("_below")
    place = inside / F.greatest(F.col("_rows") - 1, F.lit(1)) * PROBES
    lower = F.get("_probes", F.greatest(F.floor(place) - 1, F.lit(0)).cast("int"))
    upper = F.get("_probes", F.least(F.ceil(place) + 1, F.lit(PROBES)).cast("int"))
    proposed = settled(_same(still, sketches, bracket).select(*still.columns, lower.alias("_a"), upper.alias("_b")))
    # Neighbouring ranks mostly share a proposal and are counted together.
    stretch = [*bracket, "_a", "_b"]
    value, a, b = F.col("_value"), F.col("_a"), F.col("_b")
    counts = _inside(df, proposed.select(*stretch).distinct(), keys).groupBy(*stretch).agg(
        F.count_if(value < a).alias("_before"),
        F.count_if(value == a).alias("_at_a"),
        F.count_if((value > a) & (value < b)).alias("_between"),
        F.count_if((value == b) & (a < b)).alias("_at_b"),
        F.count_if(value > b).alias("_after"),
    )
    placed, outcome, start = _same(proposed, counts, stretch), None, F.col("_below")
    none = F.lit(None).cast("double")
    for size, low, high, hit in (
        (F.col("_before"), F.col("_low"), a, none),
        (F.col("_at_a"), none, none, a),
        (F.col("_between"), a, b, none),
        (F.col("_at_b"), none, none, b),
        (F.col("_after"), b, F.col("_high"), none),
    ):
        chosen = F.struct(
            low.alias("_low"), high.alias("_high"), start.alias("_below"), size.alias("_rows"), hit.alias("_found")
        )
        within = F.col("_rank") < start + size
        outcome = F.when(within, chosen) if outcome is None else outcome.when(within, chosen)
        start = start + size
    return placed.select(*keys, "_rank", outcome.alias("_next")).select(*keys, "_rank", "_next.*")

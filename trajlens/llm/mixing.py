"""Mixing documents to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are added up per cell of all margins (source, language, topic …). The cell
weights are then raked: for one margin after the other, every cell is scaled so that
the margin's totals meet their targets, until all do within ``TOLERANCE``. A cell's fitted weight over
its tokens, scaled so that the wanted share of all tokens is expected, is the
probability with which each of its documents is kept, 1 at most: a cell that is
wanted beyond what it holds is kept whole. A document is kept when a fixed hash
of its id, as a number in [0, 1), is below its probability.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import WORD, free_name, stored, text_of

SEED, SHARE = 5, 0.5
# Raking ends when no margin's total is further from its target than this share of it, or with a warning after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-4, 200
# Targets are the present shares to this power, so large groups are damped and none vanishes.
DAMPING = 0.5
# Rounds between two looks at the margins.
LOOK_ROUNDS = 4
UNKNOWN = ""


def word_count(text: Column) -> Column:
    """Words of a text: its tokens for the purpose of weights."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse kind of text, by fixed rules on what stands in it."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("Licensed under")) | F.contains(text, F.lit("Copyright")), "licence")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact")
        .otherwise("prose")
    )


def damped_targets(cells: DataFrame, margin: str, power: float = DAMPING) -> DataFrame:
    """``(margin, target)``: the margin's present token shares to a power; ``rake`` scales them to sum 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    return sums.select(margin, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(power)).alias("target"))


def _residual(fitted: DataFrame, wanted: dict[str, DataFrame]) -> float:
    """The largest relative error of a margin's total."""
    error = F.abs(F.col("_sum") / F.col("target") - 1).alias("_error")
    parts = [fitted.groupBy(m).agg(F.sum("weight").alias("_sum")).join(t.where("target > 0"), m).select(error) for m, t in wanted.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.agg(F.max("_error")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None) -> DataFrame:
    """Cells ``(margins…, tokens)`` with ``weight``, fitted to ``targets``: ``(margin, target)`` for each margin.

    Targets are scaled to sum 1 over the values that hold tokens, and so are the
    weights. A margin value without a target gets weight 0.

    Goes on until all margins meet their targets within ``TOLERANCE``. Targets that
    the cells can't meet together end it, too, and so do ``MOST_ROUNDS``; both warn
    and name the residual. With ``rounds`` there are exactly so many, and no look at it.
    """
    margins, wanted = list(targets), {}
    for margin, target in targets.items():
        present = cells.where("tokens > 0").select(margin).distinct()
        reached = stored(target.select(margin, "target").join(present, margin))
        norm = reached.agg(F.sum("target")).first()[0] or 1.0
        wanted[margin] = reached.withColumn("target", F.col("target") / F.lit(float(norm)))
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    before = float("inf")
    for done in range(1, (MOST_ROUNDS if rounds is None else rounds) + 1):
        for margin in margins:
            sums = fitted.groupBy(margin).agg(F.sum("weight").alias("_sum")).where("_sum > 0")
            factor = sums.join(wanted[margin], margin).select(margin, (F.col("target") / F.col("_sum")).alias("_factor"))
            scaled = (F.col("weight") * F.coalesce("_factor", F.lit(0.0))).alias("weight")
            fitted = fitted.join(factor, margin, "left").select(*margins, "tokens", scaled)
        fitted = stored(fitted)  # each margin reads the table twice, so a round is as long as a plan may grow
        if rounds is None and (done % LOOK_ROUNDS == 0 or done == MOST_ROUNDS):
            residual = _residual(fitted, wanted)
            if residual <= TOLERANCE:
                break
            if done == MOST_ROUNDS or residual > before * (1 - 1e-4) ** LOOK_ROUNDS:
                warnings.warn(f"raking ended after {done} rounds with margins off by up to {residual:.2%}", stacklevel=2)
                break
            before = residual
    return fitted


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of the md5 of ``id:seed``; a null id counts as the empty text."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def keep_chances(
    rows: DataFrame,
    margins: list[str],
    targets: dict[str, DataFrame] | None = None,
    share: float = SHARE,
    rounds: int | None = None,
) -> DataFrame:
    """``(margins…, probability)`` of each cell of rows ``(margins…, tokens)``; a ``share`` of all tokens is expected."""
    cells = stored(rows.groupBy(*margins).agg(F.sum("tokens").alias("tokens")))
    fitted = rake(cells, targets or {m: damped_targets(cells, m) for m in margins}, rounds)
    filled = fitted.where("tokens > 0").withColumn("ratio", F.col("weight") / F.col("tokens"))
    total = filled.agg(F.sum("tokens")).first()[0] or 0
    # Cells wanted beyond what they hold are kept whole; what they can't give, the others do.
    scale, capped = 0.0, -1
    while True:
        full = F.col("ratio") * F.lit(scale) >= 1
        n, given, open_ = filled.agg(
            F.count_if(full), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not open_:
            break
        capped, scale = n, (share * total - float(given or 0)) / open_
    chance = F.least(F.lit(1.0), F.col("weight") / F.col("tokens") * F.lit(scale))
    return stored(fitted.select(*margins, F.when(F.col("tokens") > 0, chance).otherwise(F.lit(1.0)).alias("probability")))


def mixing_plan(
    docs: DataFrame,
    margins: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: dict[str, DataFrame] | None = None,
    share: float = SHARE,
    rounds: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, margins…, tokens, probability, kept)`` per row.

    ``margins`` name columns; without ``targets`` each margin's damped present shares are its targets.

    * Null margin values: the value "" (a value of its own).
    * Null or blank text: no tokens; it moves no margin and is kept like the rest of its cell, or with
      probability 1 when its cell holds no tokens at all.
    * Null ids and repeated rows: one result per row; equal ids draw the same number.
    * Empty table: empty result. Other columns are ignored, whatever their names.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *[F.coalesce(F.col(m).cast("string"), F.lit(UNKNOWN)).alias(m) for m in margins],
            word_count(F.col(text_col)).alias("tokens"),
        )
    )
    planned = rows.join(keep_chances(rows.drop("doc_id"), margins, targets, share, rounds), margins)
    kept = uniform(F.col("doc_id"), seed) < F.col("probability")
    return planned.select("doc_id", *margins, "tokens", "probability", kept.alias("kept"))


def sample_mixture(
    docs: DataFrame, margins: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, seed: int = SEED
) -> DataFrame:
    """The rows that such a plan keeps, with their columns unchanged; ``margins`` names an expression for each margin."""
    keys = [free_name(docs, f"_margin_{name}") for name in margins]
    named = [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(k) for k, c in zip(keys, margins.values())]
    chance = free_name(docs, "_probability")
    weighed = docs.select(*named, word_count(docs[text_col]).alias("tokens"))
    chances = keep_chances(weighed, keys, share=share).withColumnRenamed("probability", chance)
    joined = docs.select("*", *named).join(chances, keys)
    return joined.where(uniform(F.col(id_col), seed) < F.col(chance)).select(*[F.col(f"`{c}`") for c in docs.columns])

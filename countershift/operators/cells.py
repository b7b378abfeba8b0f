"""Saturated decompositions of many keys at once, as DataFrame plans over cells.

Where all covariates are categories, the model of a group is its distribution in
every cell, and the counterfactual distribution mixes the reference group's
cells by the comparison group's shares. So sums by key, group, cell and outcome
are all that a decomposition needs: they add up over batches, partitions and
replications, and every key is decomposed by the same few aggregates.

Only cells that both groups of a key hold take part (common support). Keys,
groups and cells may be strings or numbers; null cells and keys must be replaced
by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countershift.operators import frame as ops

#: Reference, counterfactual (the reference's cells in the comparison's shares) and comparison distribution.
REFERENCE, COUNTERFACTUAL, COMPARISON = 0, 1, 2


def supported(cells: DataFrame, by: list[str], g: str = "g", cell: str = "cell", weight: str = "w") -> DataFrame:
    """by, cell, ``w0_``, ``w1_`` (weights of either group), ``t0_``, ``t1_`` (their sums over the cells that both hold)."""
    side = lambda k: F.sum(F.when(F.col(g) == k, F.col(weight)))
    both = cells.groupBy(*by, cell).agg(side(0).alias("w0_"), side(1).alias("w1_")).where("w0_ > 0 and w1_ > 0")
    totals = both.groupBy(*by).agg(F.sum("w0_").alias("t0_"), F.sum("w1_").alias("t1_"))
    return both.join(totals, by)


def mixed(sums: DataFrame, by: list[str], keep: list[str], measures: list[str], g: str = "g", cell: str = "cell", weight: str = "w") -> DataFrame:
    """by, keep, ``d`` and each measure summed over cells as in distribution ``d``, so that all weights of a distribution sum to one.

    ``sums`` has rows by ``by``, group, cell and ``keep`` (an outcome, or
    nothing), their weight, and measures that are already multiplied by weights.
    """
    share = supported(sums.groupBy(*by, g, cell).agg(F.sum(weight).alias(weight)), by, g, cell, weight)
    rows = sums.join(share, [*by, cell])
    own = F.when(F.col(g) == 0, F.array(F.struct(F.lit(REFERENCE).alias("d"), (1 / F.col("t0_")).alias("f")), F.struct(F.lit(COUNTERFACTUAL).alias("d"), (F.col("w1_") / F.col("w0_") / F.col("t1_")).alias("f"))))
    factors = F.explode(own.otherwise(F.array(F.struct(F.lit(COMPARISON).alias("d"), (1 / F.col("t1_")).alias("f"))))).alias("x")
    return rows.select(*by, *keep, *measures, factors).groupBy(*by, *keep, F.col("x.d").alias("d")).agg(*[F.sum(F.col(m) * F.col("x.f")).alias(m) for m in measures])


def differences(levels: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, ``effect``, ``estimate``: structure, composition and total of levels by distribution ``d``."""
    at = lambda d: F.max(F.when(F.col("d") == d, F.col(value)))
    wide = levels.groupBy(*by).agg(at(REFERENCE).alias("l0"), at(COUNTERFACTUAL).alias("l1"), at(COMPARISON).alias("l2"))
    pair = lambda name, a, b: F.struct(F.lit(name).alias("effect"), (F.col(a) - F.col(b)).alias("estimate"))
    effects = F.explode(F.array(pair("structure", "l2", "l1"), pair("composition", "l1", "l0"), pair("total", "l2", "l0"))).alias("e")
    return wide.select(*by, effects).select(*by, "e.effect", "e.estimate")


def distribution_quantiles(counts: DataFrame, by: list[str], outcome: str, probs, digits: int = 12) -> DataFrame:
    """by, ``d``, ``p``, ``q``: the least outcome at which each distribution reaches each probability, of rows by group, cell and outcome with weight ``w``.

    Probabilities reached are compared after rounding to ``digits``, so that ties don't hang on the order of a sum.
    """
    mass = mixed(counts.withColumn("mass", F.col("w").cast("double")), by, [outcome], ["mass"])
    placed = mass.withColumn("range_", ops.range_of(mass.select(F.col(outcome).cast("double").alias(outcome)), outcome))
    steps = ops.running_sums(placed, outcome, {"cdf": F.col("mass")}, [*by, "d"]).withColumn("cdf", F.round("cdf", digits))
    return ops.inverted(steps, probs, [*by, "d"], threshold=outcome, cdf="cdf")


def words(text: str | Column) -> Column:
    """Number of words, as ASCII white space separates them; 0 for null."""
    value = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(value, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")

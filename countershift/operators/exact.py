"""Sums of doubles that are the same in every layout: exact, then rounded once.

A double is a whole number times a power of two. Values are put into bins of
four binary orders of magnitude; inside a bin all are whole multiples of one
power, so a decimal adds them without rounding, in any order, before and after
the shuffle alike. A key has at most about 530 bins whatever its rows; they are
joined with rational numbers, and the one rounding comes last.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary orders of magnitude of a bin, and the bits that a whole number keeps below them: 52 of the double, and a bin for a logarithm that was rounded up.
WIDTH, KEPT = 4, 56


def _bin(v: Column) -> Column:
    return F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(v)) / WIDTH)).cast("int")


def _whole(v: Column, b: Column) -> Column:
    """The value as a multiple of its bin's unit; two factors, because their product may be no double."""
    power = F.lit(KEPT) - b * WIDTH
    half = F.floor(power / 2)
    return (v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)).cast("long").cast("decimal(38,0)")


def _rounded(total: Fraction) -> float:
    try:
        return float(total)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def _value(bins, wholes) -> Fraction:
    return sum((Fraction(int(w)) * Fraction(2) ** (WIDTH * int(b) - KEPT) for b, w in zip(bins, wholes)), Fraction(0))


def binned(frame: DataFrame, keys: list[str], column: str, times: str | None = None) -> DataFrame:
    """The keys, ``bin_``, ``rows_`` and ``whole_`` of finite values; null ones count in no bin. ``times`` names how often a row stands."""
    v = F.col(column).cast("double")
    if times is None:
        part = frame.where(v.isNotNull()).select(*keys, v.alias("v_")).withColumn("bin_", _bin(F.col("v_")))
        return part.groupBy(*keys, "bin_").agg(F.count("*").alias("rows_"), F.sum(_whole(F.col("v_"), F.col("bin_"))).alias("whole_"))
    part = frame.where(v.isNotNull()).select(*keys, v.alias("v_"), F.col(times).cast("long").alias("n_")).withColumn("bin_", _bin(F.col("v_")))
    whole = _whole(F.col("v_"), F.col("bin_")).cast("decimal(19,0)") * F.col("n_").cast("decimal(18,0)")
    return part.groupBy(*keys, "bin_").agg(F.sum("n_").alias("rows_"), F.sum(whole).alias("whole_"))


def exact_sums(frame: DataFrame, keys: list[str], column: str, name: str = "exact_sum") -> DataFrame:
    """For each combination of the keys the sum of a column of finite doubles, rounded once.

    Null values are left out and a key of nulls alone has no row. Keys may be
    null. The result doesn't depend on the order, the partitions or the tasks.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema), f"`{name}` double"])

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        out = part.iloc[:1][keys].copy()
        out[name] = _rounded(_value(part["bin_"], part["whole_"]))
        return out

    return binned(frame, keys, column).groupBy(*keys).applyInPandas(joined, schema)


def exact_totals(frame: DataFrame, key: str, column: str, times: str | None = None) -> dict[object, tuple[int, Fraction]]:
    """Rows and exact sum of few keys, on the driver."""
    out: dict[object, tuple[int, Fraction]] = {}
    for r in binned(frame, [key], column, times).collect():
        rows, total = out.get(r[key], (0, Fraction(0)))
        out[r[key]] = (rows + r["rows_"], total + _value([r["bin_"]], [r["whole_"]]))
    return out

"""Rows that are equal in all that a model sees are one row with a frequency: the same fits, quantiles, counts and resamples in law."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from countershift import Control, counterfactual_decompose, udtf
from countershift.functions.ranks import running_sum, tolerance, type7_positions
from countershift.operators.exact import exact_totals
from countershift.operators.selection import RankSearch
from countershift.plans.bootstrap import multipliers
from countershift.sources.prepare import prepare

COPIES = 6


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(240).select(
        (F.col("id") % 2).cast("int").alias("g"), (F.round(F.rand(5) * 100) + 7 * (F.col("id") % 3)).alias("y"), (F.rand(6) * 4 + 1).alias("x"),
        F.sqrt(1 + F.col("id") % 97).alias("w"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("f"), (F.col("id") % 2).cast("int").alias("k"),
    )
    return rows.crossJoin(spark.range(COPIES).withColumnRenamed("id", "copy")).drop("copy").persist()


@pytest.mark.parametrize(("formula", "model", "solver", "more"), [("y ~ f", "loc", None, {}), ("y ~ x", "locsca", None, {}), ("y ~ f", "qr", "pfnb", {}), ("y ~ f + x", "qr", "onestep", {"nreg": 25}), ("y ~ x", "cqr", "pfnb", {"censoring": "low", "nreg": 3})])
def test_decompositions_of_joined_rows(table, formula, model, solver, more):
    data = table.withColumn("low", F.lit(7.0)).withColumn("y", F.greatest("y", "low")) if "censoring" in more else table
    settings = {"nreg": 10, "reported_quantiles": (0.3, 0.5, 0.7)} | {k: v for k, v in more.items() if k == "nreg"}
    extra = {k: v for k, v in more.items() if k != "nreg"}
    near, far = (counterfactual_decompose(formula, data, "g", "w", model, solver, Control(kernel_max_mb=mb, **settings), **extra) for mb in (64, 1e-6))
    assert far.metadata["observations"] == near.metadata["observations"] == 240 * COPIES
    assert far.metadata["observations_reference"] == near.metadata["observations_reference"]
    for e in near.point.effects:
        np.testing.assert_allclose(far.point.effects[e], near.point.effects[e], atol=1e-6)
    for a, b in zip(near.crossing, far.crossing):
        assert (a["rows"], a["crossing_rows"], a["crossing_pairs"]) == (b["rows"], b["crossing_rows"], b["crossing_pairs"])


def test_joined_rows_are_fewer(table):
    """The work of every later pass is that of the distinct rows, in memory if those fit; weights and totals stay those of all rows."""
    plain, joined, small = (prepare("y ~ f", table, "g", "w", kernel_max_mb=mb, join_equal=join) for mb, join in ((1e-6, False), (1e-6, True), (0.02, True)))
    assert small.mode == "kernel" and joined.mode == "distributed"
    assert joined.mean_weight == plain.mean_weight == small.mean_weight
    for a, b, c in zip(plain.groups, joined.groups, small.groups):
        assert b.rows <= a.rows / COPIES and c.rows == b.rows and b.total == a.total == c.total
        weight = lambda z: np.array([z.w.sum(), z.freq.sum()])
        np.testing.assert_allclose(b.reduce(weight), a.reduce(weight), rtol=1e-12)
    for p in (plain, joined):
        p.release()


def test_exact_totals_of_counted_rows(table):
    counted = table.groupBy("g", "y").agg(F.count("*").alias("n"))
    assert exact_totals(counted, "g", "y", "n") == exact_totals(table, "g", "y")


@pytest.mark.parametrize("mb", [0.02, 1e-6])
def test_bootstrap_of_joined_rows(table, mb):
    """Errors are those of all rows, not of the distinct ones."""
    errors = []
    for limit in (64, mb):
        out = counterfactual_decompose("y ~ f", table, "g", "w", "loc", control=Control(nreg=10, kernel_max_mb=limit, reported_quantiles=(0.5,)), bootstrap_reps=60)
        errors.append(out.bands["total"]["std_error"][0])
    assert errors[1] == pytest.approx(errors[0], rel=0.5)


@pytest.mark.parametrize("scheme", ["counterfactual", "empirical", "multiplier"])
def test_multipliers_of_counted_rows(scheme):
    freq = np.array([1.0, 5.0, 2.0, 1000.0])
    m = multipliers(np.random.default_rng(1), 4, scheme, freq)
    assert m.sum() == freq.sum() if scheme != "multiplier" else abs(m[3] - 1000) < 200
    ones = multipliers(np.random.default_rng(2), 50, scheme, np.ones(50))
    np.testing.assert_array_equal(ones, multipliers(np.random.default_rng(2), 50, scheme))


def test_table_function_with_frequencies(spark, table):
    udtf.register(spark)
    table.createOrReplaceTempView("cf_equal")
    call = "SELECT * FROM cf_decompose(TABLE({}) PARTITION BY (k), 'y ~ f', 'g', 'w', 'loc', 'k'{}) ORDER BY 1, 2, 3"
    rows = [spark.sql(call.format(*a)).collect() for a in (("SELECT *, k AS n FROM cf_equal WHERE f <> 'c9'", ""), ("SELECT k % 1 AS k, g, y, w, f, count(*) AS m FROM cf_equal GROUP BY ALL", ", 'm'"))]
    whole = spark.sql(call.format("SELECT k % 1 AS k, g, y, w, f FROM cf_equal", "")).collect()
    assert rows[0] == [] and len(whole) == 27
    for a, b in zip(whole, rows[1]):
        assert (a["effect"], a["quantile"]) == (b["effect"], b["quantile"]) and b["estimate"] == pytest.approx(a["estimate"], abs=1e-9)


def test_ranks_that_equal_weights_meet():
    """A quarter of 300,000 rows has three times the others' weight, and so half of it: the rank is met, whatever long sums of equal weights round to."""
    n = 300_000
    w = np.concatenate([np.full(n // 4, 3.0), np.full(3 * n // 4, 1.0)])
    v, w = np.concatenate([np.zeros(n // 4), np.ones(3 * n // 4)]), w / w.mean()
    low, high, _ = type7_positions(n, np.array([0.5]))
    search = RankSearch(np.concatenate([low, high]), n, 1024, 1000)
    while search.phase != "done":
        search.advance(search.measure(v, w))
    assert search.found.tolist() == [0.0, 1.0]


def test_running_sums_of_equal_weights():
    w = np.full(10_000_000, 0.7)
    exact = float(Fraction(0.7) * len(w))
    assert abs(float(running_sum(w)[-1]) - exact) < tolerance(exact) / 100

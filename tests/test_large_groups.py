"""What the driver solves, and how often all rows are read, hardly grow with a group on executors; fits stay those of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countershift import Control, counterfactual_decompose
from countershift.operators import qr, qrkernel
from countershift.operators.blocks import LocalBlocks, SparkBlocks
from countershift.sources.prepare import prepare

TAUS = np.array([0.05, 0.3, 0.5, 0.9])


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(7)
    n = 60_000
    x = np.column_stack([np.ones(n), rng.uniform(size=n), rng.integers(0, 2, n)])
    return x, x @ [1.0, 2.0, -1.0] + (1 + x[:, 1]) * rng.standard_t(3, n), 0.5 + rng.integers(1, 9, n) / 4


def test_problems_solved_at_once_are_bounded(matrix, monkeypatch):
    """F2 pfnb_general, F3 qr_distributed_decomp: samples and bands grew with the group, eight of them in the driver at once."""
    x, y, w = matrix
    monkeypatch.setattr(qr, "SOLVED_ROWS", 1000, raising=False)
    rows, exact = [], qrkernel.exact
    monkeypatch.setattr(qrkernel, "exact", lambda x, *a: rows.append(len(x)) or exact(x, *a))
    found = qr.fit_process(LocalBlocks(x, y, w), TAUS, "pfnb")
    assert found.info["converged"] and max(rows) <= 2500
    for k, tau in enumerate(TAUS):
        b = found.coefficients[:, k]
        np.testing.assert_allclose(b, exact(x * w[:, None], y * w, tau, b)[0], atol=1e-9)
        assert qrkernel.certificate(x * w[:, None], y * w, tau, b) > -1e-6


def test_samples_end_where_the_band_is_bounded():
    assert qr.sample_sizes(1e6, 3) == [17320]  # as before for groups whose bands are small
    for n in (2e7, 2e8):
        sizes = qr.sample_sizes(n, 5)
        assert max(3 * np.sqrt(5 / a) * b for a, b in zip(sizes, [*sizes[1:], n])) <= 1.01 * qr.SOLVED_ROWS and sizes[0] <= qr.SOLVED_ROWS


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(6000).select((F.col("id") % 2).cast("int").alias("g"), F.rand(3).alias("x"), (F.col("id") % 3).cast("string").alias("f"), (1 + F.col("id") % 5).cast("double").alias("w"), F.randn(4).alias("e"))
    return rows.withColumn("y", 10 + 3 * F.col("x") + F.col("g") + F.col("e") * (1 + F.col("x"))).persist()


def test_one_step_process_shares_passes(table, monkeypatch):
    """F1 onestep_general: five passes for every quantile, now two for one quantile up and one down."""
    passes, reduce = [], SparkBlocks.reduce
    control = dict(nreg=25)
    near = counterfactual_decompose("y ~ x + f", table, "g", "w", "qr", "onestep", Control(**control))
    prepared = prepare("y ~ x + f", table, "g", "w", kernel_max_mb=1e-6)
    monkeypatch.setattr(SparkBlocks, "reduce", lambda self, *a: passes.append(1) or reduce(self, *a))
    fit = qr.fit_process(prepared.groups[0], Control(**control).for_model("qr"), "onestep", Control(**control))
    assert len(passes) <= 50
    # quartiles differ by their definition between the two paths, and bandwidths with them
    np.testing.assert_allclose(fit.coefficients, near.point.fits[0].coefficients, rtol=0.02, atol=0.02)
    assert fit.info["fallbacks"].sum() == 0 and set(fit.info["inverses"]) == set(range(25)) - {12}
    prepared.release()


@pytest.mark.parametrize("window", [100_000, 20])
def test_quartiles_along_the_process_are_exact(table, monkeypatch, window):
    """Windows that hold the ranks, and windows too narrow for them, give the quartiles of all residuals."""
    from countershift.operators.selection import quantiles

    monkeypatch.setattr(qr, "WINDOW_ROWS", window)
    seen, found = [], qr._Quartiles.found
    monkeypatch.setattr(qr._Quartiles, "found", lambda self, *a: seen.append((self, found(self, *a))) or seen[-1][1])
    fits, windows = [], qr._Quartiles.windows
    monkeypatch.setattr(qr._Quartiles, "windows", lambda self, b: fits.append(b) or windows(self, b))
    prepared = prepare("y ~ x", table, "g", "w", kernel_max_mb=1e-6)
    blocks = prepared.groups[1]
    qr.fit_process(blocks, np.arange(0.4, 0.62, 0.04), "onestep", Control())
    hits = [(b, v) for b, (_, v) in zip(fits, seen) if v is not None]
    assert hits and len(seen) == len(fits)
    for b, v in hits:
        np.testing.assert_allclose(v, quantiles(blocks, lambda z, b=b: (z.y - z.x @ b)[:, None], 1, [0.25, 0.75], Control()).values, rtol=1e-12)
    prepared.release()


def test_constant_columns_stay_where_they_are(table):
    """F1 to F3: every pass sent the intercept, frequencies, limits and events to Python, row by row."""
    prepared = prepare("y ~ x + f", table, "g", "w", kernel_max_mb=1e-6)
    near = prepare("y ~ x + f", table, "g", "w")
    for a, b in zip(prepared.groups, near.groups):
        assert a.sent == ["x_1", "x_2", "x_3", "y", "w"]
        for z in a.design(np.eye(4)[:, [0, 2]]), a:
            sums = z.reduce(lambda k: np.array([len(k.y), k.x[:, 0].sum(), k.freq.sum(), k.cens.sum(), k.event.sum()]))
            np.testing.assert_array_equal(sums, [b.rows, b.rows, b.rows, 0, b.rows])
    prepared.release()

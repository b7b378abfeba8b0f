"""Literal cases with answers that need no generator, and optimality certificates."""

import numpy as np
import pandas as pd
import pytest

from countershift.control import Control
from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.functions import curves, linalg, ranks
from countershift.operators import dr, qrkernel
from countershift.operators.blocks import LocalBlocks
from countershift.operators.cox import km_quantiles
from countershift.operators.marginal import crossing_row, marginal_quantiles
from countershift.operators.models import Fit
from countershift.operators.qr import fit_process, fit_weighted_qr, resolve_solver
from countershift.operators.selection import quantiles
from countershift.plans.inference import effect_bands, functional_tests
from countershift.result import islands
from countershift.sources.prepare import subsample_targets
from countershift.sources.synthetic import SCENARIOS, draw


def test_weighted_quantiles():
    assert ranks.weighted_type2([1, 2, 3, 4], np.ones(4), [0.5])[0] == 2.5
    assert ranks.weighted_type2([1, 2, 3], [1, 1, 2], [0.5])[0] == 2.5
    np.testing.assert_allclose(ranks.weighted_type7([-2, -1, 0, 4, 9], np.ones(5), [0.25, 0.5, 0.75]), [-1, 0, 4])
    assert ranks.weighted_type7([0, 10], [2, 1], [0.5], 3)[0] == 0
    x = np.random.default_rng(0).normal(size=101)
    np.testing.assert_allclose(ranks.weighted_type7(x, np.full(101, 7.0), [0.1, 0.37, 0.9]), np.quantile(x, [0.1, 0.37, 0.9]), atol=1e-12)
    with pytest.raises(DecompositionError):
        ranks.weighted_type7([1, np.inf], [1, 1], [0.5])


def test_curves():
    t, f, c = curves.correct_cdf([1, 2, 3], [0.2, 0.8, 0.4], "cummax")
    assert curves.invert_step(t, f, [0.5])[0] == 2 and (c.raw_crossing_pairs, c.corrected_crossing_pairs, round(c.max_adjustment, 12)) == (1, 0, 0.4)
    assert curves.invert_step(*curves.correct_cdf([1, 2, 3], [0.2, 0.8, 0.4], "none")[:2], [0.5])[0] == 2
    assert curves.invert_step(*curves.correct_cdf([1, 2, 3], [0.2, 0.8, 0.4], "rearrange")[:2], [0.5])[0] == 3
    t, f, c = curves.correct_cdf([1, 2, 3, 4], [-0.2, 0.7, 1.3, 0.6], "none")
    assert curves.invert_step(t, f, [0.5])[0] == 2 and (c.raw_crossing_pairs, c.out_of_bounds_values) == (1, 2)
    np.testing.assert_allclose([c.max_bound_adjustment, c.max_adjustment], 0.3)
    np.testing.assert_allclose(curves.isotonic(np.array([1, 3, 2, 4])), [1, 2.5, 2.5, 4])
    for name in curves.LINKS:
        np.testing.assert_allclose(curves.inverse_link(name, np.array([curves.link(name, 0.3)])), 0.3)


def test_rank_and_matroid():
    first = np.array([[1, 1, 0, 1], [1, 1, 0, 2], [1, 1, 0, 3], [1, 1, 1, 4.0]])
    assert linalg.common_columns(np.eye(4), np.eye(4)) == [0, 1, 2, 3]
    assert 1 not in linalg.common_columns(first, np.eye(4))
    # a is lost in one group, b = a + c in the other: b and c stay
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=8), rng.normal(size=8)
    one, two = np.column_stack([np.ones(8), a, a, c]), np.column_stack([np.ones(8), np.ones(8), a, c])
    assert linalg.common_columns(one, two) == [0, 2, 3]
    with pytest.raises(NotIdentifiedError):
        linalg.common_columns(np.zeros((3, 2)), np.eye(2))


@pytest.mark.parametrize("tau", [0.02, 0.3, 0.5, 0.9])
def test_exact_fits_are_certified(tau):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(300), rng.normal(size=300), rng.integers(0, 3, 300)])
    for y in (rng.normal(size=300), np.round(rng.normal(size=300)), 1e6 * rng.normal(size=300)):
        b, ok, _ = qrkernel.exact(x, y, tau)
        assert ok and qrkernel.certificate(x, y, tau, b, rng.normal(size=(20, 3))) > -1e-6 * np.abs(y).max()


def test_solvers_agree_and_rows_repeat():
    rng = np.random.default_rng(2)
    n = 400
    x, w = np.column_stack([np.ones(n), rng.normal(size=n)]), rng.uniform(0.5, 2, n)
    y = x[:, 1] + rng.normal(size=n)
    fits = {s: fit_weighted_qr(x, y, w, [0.2, 0.5, 0.7], s).coefficients for s in ("br", "fn", "pfn", "qfnb", "pfnb", "proqreg", "profn")}
    for b in fits.values():
        np.testing.assert_allclose(b, fits["br"], atol=1e-8)
    f = rng.integers(1, 4, n)
    one = fit_weighted_qr(x, y, w, [0.3], "br", frequency=f).coefficients
    other = fit_weighted_qr(np.repeat(x, f, axis=0), np.repeat(y, f), np.repeat(w, f), [0.3], "br").coefficients
    np.testing.assert_allclose(one, other, atol=1e-8)
    near = fit_weighted_qr(x, y, w, np.arange(0.1, 0.91, 0.02), "onestep").coefficients
    exact = fit_weighted_qr(x, y, w, np.arange(0.1, 0.91, 0.02), "br").coefficients
    assert np.abs(near - exact).max() < 0.35
    with pytest.raises(DecompositionError):
        fit_weighted_qr(x, y, w, [0.1, 0.5], "onestep")
    assert [resolve_solver("auto", n, t) for n, t in ((100, 5), (20_000, 5), (100, 50), (20_000, 50))] == ["br", "pfn", "qfnb", "pfnb"]
    approximate = fit_process(LocalBlocks(x, y, w), [0.5], "cuda_admm", Control(gpu_qr_allow_nonconvergence=True)).coefficients
    np.testing.assert_allclose(approximate, fit_weighted_qr(x, y, w, [0.5], "br").coefficients, atol=0.02)


def test_selection_equals_sorting():
    rng = np.random.default_rng(3)
    for w in (np.ones(500), 10.0 ** rng.uniform(-8, 8, 500)):
        blocks = LocalBlocks(np.ones((500, 1)), np.round(rng.normal(size=500), 1), w)
        draws = lambda b: b.y[:, None] + np.array([0.0, 0.5, -1.0])
        a = quantiles(blocks, draws, 3, [0.1, 0.5, 0.99], Control(marginal_method="matrix"))
        b = quantiles(blocks, draws, 3, [0.1, 0.5, 0.99], Control(marginal_method="chunked", marginal_histogram_bins=256))
        np.testing.assert_allclose(a.values, b.values, atol=1e-10)
        assert b.method == "chunked" and b.passes >= 3


def test_crossing_and_rearrangement():
    fit = Fit("qr", np.array([0.25, 0.5, 0.75]), np.array([[3.0, 1.0, 2.0]]))
    blocks = LocalBlocks(np.ones((4, 1)), np.zeros(4), np.array([1.0, 2, 3, 4]))
    raw, fixed = (crossing_row(fit, blocks, "d", Control(), c) for c in (False, True))
    assert (raw["crossing_rows"], raw["crossing_pairs"], raw["max_crossing"], raw["weighted_crossing_row_share"]) == (4, 4, 2.0, 1.0)
    assert fixed["crossing_pairs"] == 0
    plain, _ = marginal_quantiles(fit, blocks, [0.3, 0.6], Control())
    sorted_, _ = marginal_quantiles(fit, blocks, [0.3, 0.6], Control(quantile_noncrossing="rearrange"))
    np.testing.assert_allclose(plain, sorted_, atol=1e-12)


def test_kaplan_meier_boundaries():
    y, event = np.arange(1.0, 11), np.array([1, 1] + [0] * 8)
    q = km_quantiles(y, event, np.ones(10), [0.1, 0.5, 0.9])
    assert np.isfinite(q[0]) and np.isnan(q[1:]).all()
    np.testing.assert_array_equal(km_quantiles(y, event, np.ones(10), [0.5, 0.9], "cap"), [2, 2])
    with pytest.raises(NotIdentifiedError):
        km_quantiles(y, event, np.ones(10), [0.5], "error")


def test_grids_and_thresholds():
    c = Control(nreg=5, trimming=0.2)
    np.testing.assert_allclose(c.grid, [0.3, 0.5, 0.7])
    np.testing.assert_allclose(c.full_grid, [0.1, 0.3, 0.5, 0.7, 0.9])
    assert len(Control().grid) == 100
    with pytest.raises(DecompositionError):
        Control(nreg=3, trimming=0.49999, reported_quantiles=(0.5,)) and Control(nreg=4, trimming=0.4)
    assert list(dr.threshold_places(1, 9)) == [0] and len(dr.threshold_places(6, 9)) == 6
    places = dr.threshold_places(1000, 9)
    assert places[0] == 0 and places[-1] == 999 and len(places) == 9
    assert subsample_targets(5, 995, 100, 2) == (3, 97)


def test_separated_responses_are_flagged():
    x = np.repeat([-1.0, 0, 1], 80)
    blocks = LocalBlocks(np.column_stack([np.ones(240), x]), np.where(x > 0, 0.0, np.where(x < 0, 1.0, np.tile([0.0, 1.0], 120))), np.ones(240))
    _, codes, _ = dr.fit_binary(blocks, "logit", np.array([0.5]), 100, 1e-8, np.array([1.0, 0.0]))
    assert codes[0] == 2


def test_bands():
    point = np.array([1.0, 1.0, 1.0])
    draws = np.array([[0.9, 0.9, 1.2], [1.1, np.nan, 1.2], [1.0, 1.1, 1.2]])
    out = effect_bands(point, draws)
    assert list(out["bootstrap_reps_effective"]) == [3, 2, 3]
    assert np.isnan(out["uniform_lower"][1]) and out["std_error"][2] == 0
    constant = effect_bands(np.array([0.2]), np.full((3, 1), 0.2))
    assert constant["uniform_lower"][0] == constant["uniform_upper"][0] == 0.2
    lost = effect_bands(np.array([np.nan]), np.ones((3, 1)))
    assert not lost["identified"][0] and np.isnan(lost["std_error"][0]) and lost["bootstrap_reps_effective"][0] == 0


def test_functional_tests_scale():
    rng = np.random.default_rng(0)
    q = np.arange(0.1, 0.91, 0.1)
    point = {e: rng.normal(size=9) for e in ("structure", "composition", "total")}
    draws = {e: point[e] + rng.normal(size=(30, 9)) for e in point}
    rows = functional_tests(q, point, draws, constants=[0.1])
    assert len(rows) == 15
    scaled = functional_tests(q, {e: 1e6 * v for e, v in point.items()}, {e: 1e6 * v for e, v in draws.items()}, constants=[1e5])
    np.testing.assert_allclose([r["ks_statistic"] for r in rows], [r["ks_statistic"] for r in scaled])


def test_truth_and_islands():
    for s in SCENARIOS:
        t = s.truth([0.2, 0.5, 0.9])
        np.testing.assert_allclose(t["structure"] + t["composition"], t["total"], atol=1e-12)
        d = draw(s, 200_000, 1)
        empirical = d[d.group == 1].y.quantile(0.5) - d[d.group == 0].y.quantile(0.5)
        assert abs(empirical - t["total"][1]) < 0.02
    assert islands(np.array([True, True, False, True])) == [(0, 2), (3, 4)]


@pytest.mark.parametrize("bad", [{"nreg": 2}, {"trimming": 0.5}, {"alpha": 0}, {"dr_noncrossing": "x"}, {"cqr_nsteps": 2}, {"gpu_backend": "cuda"}, {"reported_quantiles": (0,)}, {"robust_se": 1}, {"legacy_weighted_quantile": True, "marginal_method": "chunked"}])
def test_control_refuses(bad):
    with pytest.raises(DecompositionError):
        Control(**bad)


def test_deprecated_alias():
    with pytest.warns(DeprecationWarning):
        assert Control(weighted_bootstrap=False).bootstrap_scheme == "empirical"


def test_multiplier_errors_equal_the_analytic_ones(spark):
    """Standard errors of a difference of weighted means, replications that don't go together, and weights of mean and variance one."""
    from countershift.operators import frame as ops

    rng = np.random.default_rng(5)
    n = 4000
    data = pd.DataFrame({"k": np.arange(n) * 7919 + (np.arange(n) % 3 << 33), "g": np.arange(n) % 2, "y": rng.normal(size=n) * 3 + np.arange(n) % 2, "w": 1.0 + np.arange(n) % 5})
    frame = spark.createDataFrame(data)
    draws = ops.multiplier_draws(frame, "k", "y", "g", "w", 400).toPandas().sort_values("rep").effect.to_numpy()
    variance = 0.0
    for _, x in data.groupby("g"):
        m = np.average(x.y, weights=x.w)
        variance += (x.w**2 * (x.y - m) ** 2).sum() / x.w.sum() ** 2
    assert abs(draws.std(ddof=1) / np.sqrt(variance) - 1) < 0.15
    assert abs(np.corrcoef(draws[1:], draws[:-1])[0, 1]) < 0.15
    weights = ops.multipliers(frame.limit(500).selectExpr("k", "1.0 AS w", "g"), "k", "w", 50, ["k"]).toPandas().pivot(index="k", columns="rep", values="w")
    assert abs(weights.to_numpy().mean() - 1) < 0.03 and abs(weights.to_numpy().var() - 1) < 0.1
    off = np.corrcoef(weights.to_numpy().T) - np.eye(50)
    assert np.abs(off).max() < 0.25 and abs(off.mean()) < 0.01


@pytest.mark.parametrize("outlier", [0.0, 1e6, 1e12, -1e15])
def test_chunked_quantiles_with_an_outlier(outlier):
    """Values far closer together than a bin of the whole range is wide."""
    from countershift.functions.ranks import weighted_type7

    rng = np.random.default_rng(3)
    y = np.append(rng.normal(size=5000), [outlier] * 2)
    w = rng.uniform(0.5, 2, len(y))
    w *= len(y) / w.sum()
    blocks, probs = LocalBlocks(np.ones((len(y), 1)), y, w), np.array([0.01, 0.25, 0.5, 0.9, 0.999])
    control = Control(marginal_method="chunked", marginal_histogram_bins=256, marginal_candidate_max=40)
    found = quantiles(blocks, lambda b: b.y[:, None], 1, probs, control)
    np.testing.assert_allclose(found.values, weighted_type7(y, w, probs, float(len(y))), rtol=1e-12, atol=1e-12)
    assert found.method == "chunked"

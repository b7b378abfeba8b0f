"""Replications that share passes: the same draws, the same refits and the same effects as one by one, in as many passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countershift.control import Control
from countershift.operators import selection
from countershift.operators.blocks import LocalBlocks, SparkBlocks
from countershift.plans import bootstrap, shared
from countershift.plans.bootstrap import StableRows, attempt_seed
from countershift.plans.decompose import counterfactual_decompose, estimate_point, evaluate
from countershift.sources.prepare import prepare

REPS, SEED = 4, 5


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 900
    d = pd.DataFrame({"x1": rng.normal(size=n), "x2": rng.integers(0, 2, n).astype(float), "g": np.arange(n) % 2, "w": rng.uniform(0.5, 2, n)})
    d["y"] = 1 + 0.5 * d.x1 + 0.3 * d.x2 + d.g * (0.4 + 0.2 * d.x1) + (1 + 0.3 * d.x2) * rng.normal(size=n)
    d = pd.concat([d, d.iloc[:200], d.iloc[:40]])  # rows that stand twice and three times
    return spark.createDataFrame(d).repartition(3).cache()


def local(blocks: SparkBlocks) -> LocalBlocks:
    got = blocks.gather(lambda b: (b.x, b.y, b.w, b.freq))
    order = np.lexsort((got[1], *got[0].T))
    return LocalBlocks(*(v[order] for v in got))


def prepared(table, **more):
    return prepare("y ~ x1 + x2", table, "g", "w", kernel_max_mb=1e-6, **more)


@pytest.mark.parametrize("scheme", ["counterfactual", "empirical", "multiplier"])
def test_replicated_draws_are_those_of_one_by_one(table, scheme):
    p = prepared(table)
    rows = StableRows(p.groups[0], 0)
    seeds = [attempt_seed(SEED, r, 0) for r in range(1, REPS + 1)]
    many = rows.replicated(scheme, seeds)
    x, y, w, m = many.gather(lambda b: (b.x, b.y, b.w, b.freq))
    for k, s in enumerate(seeds):
        one = local(rows.resample(scheme, s))
        keep = np.flatnonzero(m[:, k] > 0)
        order = keep[np.lexsort((y[keep], *x[keep].T))]
        np.testing.assert_array_equal(one.block.y, y[order])
        np.testing.assert_allclose(one.block.w, w[order] * m[order, k], rtol=1e-15)
    if scheme == "multiplier":  # equal rows weigh as many
        assert m[:, :].sum() / REPS == pytest.approx(p.groups[0].rows, rel=0.1)
    else:
        assert (m.sum(axis=0) == p.groups[0].rows).all()
    p.release()


@pytest.mark.parametrize(("engine", "scheme"), [("onestep", "counterfactual"), ("xy_preprocess", "multiplier")])
def test_shared_effects_equal_one_by_one(table, engine, scheme):
    solver = "onestep" if engine == "onestep" else "pfnb"
    control = Control(nreg=20, bootstrap_scheme=scheme, qr_bootstrap_engine=engine)
    p = prepared(table)
    point = estimate_point(p.groups, "qr", solver, control)
    rows = [StableRows(b, g) for g, b in enumerate(p.groups)]
    seeds = [attempt_seed(SEED, r, 0) for r in range(1, REPS + 1)]
    found, good, passes = shared.effects(tuple(x.replicated(scheme, seeds) for x in rows), point, engine, control)
    assert good.all()
    for k, s in enumerate(seeds):
        drawn = tuple(local(x.resample(scheme, s)) for x in rows)
        refit = bootstrap._onestep if engine == "onestep" else bootstrap._xy
        expected = evaluate(drawn, tuple(refit(g, f) for g, f in zip(drawn, point.fits)), "qr", control, with_observed=False)[0]
        for e in expected:
            np.testing.assert_allclose(found[e][k], expected[e], atol=1e-7)
    p.release()


@pytest.mark.parametrize(("model", "scheme"), [("loc", "counterfactual"), ("locsca", "multiplier")])
def test_shared_location_models_equal_one_by_one(table, model, scheme):
    control = Control(nreg=15, bootstrap_scheme=scheme)
    p = prepared(table)
    point = estimate_point(p.groups, model, None, control)
    rows = [StableRows(b, g) for g, b in enumerate(p.groups)]
    seeds = [attempt_seed(SEED, r, 0) for r in range(1, REPS + 1)]
    assert shared.supports(model, None, control, p.groups) and not shared.supports("lpm", None, control, p.groups)
    found, good, _ = shared.effects(tuple(x.replicated(scheme, seeds) for x in rows), point, "standard", control)
    assert good.all()
    for k, s in enumerate(seeds):
        drawn = tuple(local(x.resample(scheme, s)) for x in rows)
        expected = estimate_point(drawn, model, None, control, with_observed=False).effects
        for e in expected:
            np.testing.assert_allclose(found[e][k], expected[e], atol=1e-8)
    p.release()


@pytest.mark.parametrize("engine", ["onestep", "xy_preprocess"])
def test_passes_do_not_depend_on_the_replications(table, monkeypatch, engine):
    control = Control(nreg=20, qr_bootstrap_engine=engine)
    p = prepared(table)
    point = estimate_point(p.groups, "qr", "onestep" if engine == "onestep" else "pfnb", control)
    rows, counted = [StableRows(b, g) for g, b in enumerate(p.groups)], []
    reduce = SparkBlocks.reduce
    monkeypatch.setattr(SparkBlocks, "reduce", lambda self, *a: counted.append(1) or reduce(self, *a))
    made = []
    for reps in (2, 30):
        counted.clear()
        _, good, passes = shared.effects(tuple(x.replicated("counterfactual", list(range(1, reps + 1))) for x in rows), point, engine, control)
        assert good.all()
        made.append((len(counted), passes))
    # marginal searches may differ by a level
    assert abs(made[0][0] - made[1][0]) <= 4 + 3 * 2 * 2 and made[1][0] < 100
    p.release()


def test_narrow_bands_widen_until_the_fit_is_exact(table, monkeypatch):
    monkeypatch.setattr(shared, "BAND", 0.3)
    control = Control(nreg=9)
    p = prepared(table)
    point = estimate_point(p.groups, "qr", "pfnb", control)
    rows, seeds = StableRows(p.groups[0], 0), [attempt_seed(SEED, r, 0) for r in range(1, 5)]
    many = rows.replicated("counterfactual", seeds)
    totals, gram = shared.sums(many)
    found = shared.exact(many, np.asarray(point.fits[0].grid), point.fits[0].coefficients, gram, np.ones(4, bool))
    assert found.passes > 1 + 3 * 2
    for k in np.flatnonzero(found.good):
        np.testing.assert_allclose(found.coefficients[k], bootstrap._xy(local(rows.resample("counterfactual", seeds[k])), point.fits[0]).coefficients, atol=1e-7)
    p.release()


def test_bootstrap_on_executors_is_complete(spark, table, tmp_path, monkeypatch):
    """Through the public entry: first attempts share passes, replications without full rank are tried on their own, runs resume."""
    made, effects = [], shared.effects
    monkeypatch.setattr(shared, "effects", lambda *a: made.append(effects(*a)) or made[-1])
    rare = table.withColumn("x2", F.when(F.col("y") > F.lit(3.2), 1.0).otherwise(0.0))
    make = lambda reps, n: counterfactual_decompose("y ~ x1 + x2", rare.repartition(n), "g", "w", "qr", "pfnb", Control(nreg=9, kernel_max_mb=1e-6), bootstrap_reps=reps, checkpoint_dir=str(tmp_path), seed=3)
    four, six = make(4, 2), make(6, 5)
    assert np.isfinite(six.draws["total"]).all()
    assert [len(good) for _, good, _ in made] == [4, 2] and any(good.any() for _, good, _ in made)
    np.testing.assert_allclose(four.draws["total"], six.draws["total"][:4])
    assert six.metadata["bootstrap_signature"] == four.metadata["bootstrap_signature"]


def test_full_rank_flags_dependent_columns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) * [1, 1e4, 1e-4]
    bad = x.copy()
    bad[:, 2] = bad[:, 0] * 2
    assert shared.full_rank(np.stack([x.T @ x, bad.T @ bad, np.diag([1.0, 0.0, 1.0])])).tolist() == [True, False, False]


def test_searches_side_by_side_equal_one_by_one():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(5000, 1)), rng.normal(size=5000), rng.uniform(0.1, 2, 5000)
    blocks, control = LocalBlocks(x, y, w), Control(marginal_histogram_bins=256, marginal_candidate_max=1000)
    scale = [1.0, 5.0, 0.0, 1e-9]
    values = lambda b, i: (np.round(b.y * scale[i], 12), b.w * (1 + i))
    ranks = np.array([1.0, 17.0, 2500.0, 4999.5, 5000.0])
    found = selection.select_together(blocks, values, [ranks] * 4, [5000.0] * 4, control)
    for i in range(4):
        v, weights = values(blocks.block, i)
        order = np.argsort(v, kind="stable")
        running = np.cumsum(weights[order]) * 5000 / weights.sum()
        np.testing.assert_allclose(found[i], [v[order][min(np.searchsorted(running, r - 1e-7), 4999)] for r in ranks], atol=1e-12)

"""Extensions that run where the rows lie, and whole-process preprocessing."""

import numpy as np
import pandas as pd
import pytest

import countershift as cs
from countershift import Control, Mergeable, registry
from countershift.errors import DecompositionError
from countershift.operators import qr
from countershift.operators.blocks import LocalBlocks, SparkBlocks
from countershift.plans.decompose import counterfactual_decompose as decompose
from countershift.sources.prepare import prepare


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 1500
    d = pd.DataFrame({"x": rng.normal(size=n), "z": rng.integers(0, 2, n).astype(float), "g": np.arange(n) % 2, "w": rng.uniform(0.5, 2, n)})
    d["y"] = 1 + 0.5 * d.x + 0.3 * d.z + 0.4 * d.g + (1 + 0.5 * d.z) * rng.normal(size=n)
    return spark.createDataFrame(d).repartition(4).cache()


@pytest.fixture()
def clean():
    before = registry.snapshot()
    yield
    registry.restore(before)


add = lambda a, b: tuple(x + y for x, y in zip(a, b))
LEAST_SQUARES = Mergeable(
    partial=lambda x, t, w, state: ((x * w[:, None]).T @ x, (x * w[:, None]).T @ t), merge=add, finish=lambda sums, state: (np.linalg.solve(*sums), True),
)


def logit_step(x, t, w, b):
    p = 1 / (1 + np.exp(-x @ b))
    info = np.einsum("ik,ij,il->kjl", w[:, None] * p * (1 - p), x, x)
    return info, x.T @ (w[:, None] * (t - p))


def newton(sums, b):
    change = np.stack([np.linalg.solve(i, s) for i, s in zip(sums[0], sums[1].T)], axis=1)
    return b + change, np.abs(change).max() < 1e-9


LOGIT = Mergeable(partial=logit_step, merge=add, finish=newton, start=lambda p, m, what: np.zeros((p, m)), rounds=200)


def majorised(x, t, w, state):
    taus, b = state
    r = t - x @ b
    a = w[:, None] / (1e-3 + np.abs(r))
    return np.einsum("ik,ij,il->kjl", a, x, x), x.T @ (a * t + w[:, None] * (2 * taus - 1))


def minimised(sums, state):
    b = np.stack([np.linalg.solve(i, s) for i, s in zip(sums[0], sums[1].T)], axis=1)
    return (state[0], b), np.abs(b - state[1]).max() < 1e-7


SMOOTHED = Mergeable(partial=majorised, merge=add, finish=minimised, start=lambda p, m, taus: (np.asarray(taus), np.zeros((p, m))), coefficients=lambda state: state[1], rounds=2000)


def both(table, model, **more):
    return [decompose("y ~ x + z", table, "g", "w", model, control=Control(nreg=12, kernel_max_mb=mb, **more.get("control", {})), **{k: v for k, v in more.items() if k != "control"}) for mb in (64, 1e-6)]


@pytest.mark.parametrize(("model", "kind", "own", "built"), [("loc", "linear_backend", LEAST_SQUARES, "chol"), ("lpm", "linear_backend", LEAST_SQUARES, "chol")])
def test_mergeable_backends_need_no_gather(table, clean, monkeypatch, model, kind, own, built):
    cs.register_conditional_backend("mine", "linear" if kind == "linear_backend" else "distribution", None, mergeable=own)
    monkeypatch.setattr(SparkBlocks, "gather", lambda *a: pytest.fail("rows were gathered"))
    expected = both(table, model, control={kind: built})
    for a, b in zip(expected, both(table, model, control={kind: "mine"})):
        for e in a.point.effects:
            np.testing.assert_allclose(a.point.effects[e], b.point.effects[e], atol=1e-6)


def test_mergeable_distribution_backend(table, clean, monkeypatch):
    from countershift.operators import dr

    monkeypatch.setattr(dr, "select_thresholds", lambda *a: np.array([0.0, 0.8, 1.5, 2.5]))
    cs.register_conditional_backend("mine", "distribution", None, mergeable=LOGIT)
    monkeypatch.setattr(SparkBlocks, "gather", lambda *a: pytest.fail("rows were gathered"))
    p = prepare("y ~ x + z", table, "g", "w", kernel_max_mb=1e-6)
    built, own = (dr.fit_distribution(p.groups[0], "logit", Control(nreg=12, dr_backend=b)) for b in ("glm", "mine"))
    np.testing.assert_allclose(own.coefficients, built.coefficients, atol=1e-6)
    p.release()


def test_mergeable_solver_on_executors(table, clean, monkeypatch):
    cs.register_qr_solver("smoothed", None, exact=False, mergeable=SMOOTHED)
    monkeypatch.setattr(SparkBlocks, "gather", lambda *a: pytest.fail("rows were gathered"))
    taus = np.array([0.25, 0.5, 0.8])
    near, far = (prepare("y ~ x + z", table, "g", "w", kernel_max_mb=mb) for mb in (64, 1e-6))
    a, b, exact = (qr.fit_process(p.groups[0], taus, s).coefficients for p, s in ((near, "smoothed"), (far, "smoothed"), (near, "pfn")))
    np.testing.assert_allclose(a, b, atol=1e-6)
    np.testing.assert_allclose(a, exact, atol=0.03)
    far.release()


def test_what_is_not_mergeable_is_refused(clean):
    first = Mergeable(partial=lambda x, t, w, s: np.linalg.lstsq(x, t, rcond=None)[0], merge=lambda a, b: (a + b) / 2, finish=lambda sums, s: (sums, True))
    with pytest.raises(DecompositionError, match="cut into blocks"):
        cs.register_conditional_backend("mean.of.fits", "linear", None, mergeable=first)
    endless = Mergeable(partial=lambda x, t, w, s: x.T @ t, merge=lambda a, b: a + b, finish=lambda sums, s: (sums, False), rounds=3)
    with pytest.raises(DecompositionError, match="not done"):
        cs.register_conditional_backend("endless", "linear", None, mergeable=endless)
    with pytest.raises(DecompositionError, match="shape"):
        cs.register_qr_solver("short", None, exact=True, mergeable=Mergeable(partial=lambda x, t, w, s: x.T @ t, merge=lambda a, b: a + b, finish=lambda sums, s: (sums, True)))
    with pytest.raises(DecompositionError, match="Mergeable"):
        cs.register_qr_solver("none", None, exact=True, mergeable=3)
    with pytest.raises(DecompositionError, match="callable"):
        cs.register_qr_solver("none", None, exact=True)
    cs.register_conditional_backend("fine", "linear", None, mergeable=LEAST_SQUARES)
    one = registry.backends["linear", "fine"].fingerprint
    cs.register_conditional_backend("fine", "linear", None, mergeable=LOGIT if False else Mergeable(LEAST_SQUARES.partial, add, lambda sums, s: (np.linalg.solve(*sums) + 0.0, True)), overwrite=True)
    assert registry.backends["linear", "fine"].fingerprint != one


@pytest.mark.parametrize("solver", ["proqreg", "profn"])
def test_whole_process_takes_fewer_passes(table, monkeypatch, solver):
    taus = np.arange(1, 100) / 100
    p = prepare("y ~ x + z", table, "g", "w", kernel_max_mb=1e-6)
    counted, reduce = [], SparkBlocks.reduce
    monkeypatch.setattr(SparkBlocks, "reduce", lambda self, *a: counted.append(1) or reduce(self, *a))
    plain = qr.fit_process(p.groups[0], taus, "pfn")
    many = len(counted)
    counted.clear()
    whole = qr.fit_process(p.groups[0], taus, solver)
    assert whole.info["process_fallback"] is None and whole.info["converged"] and len(counted) < many / 2
    x, y, w = p.groups[0].gather(lambda b: (b.x, b.y, b.w))
    loss = lambda b: ((w[:, None] * np.where((r := y[:, None] - x @ b) > 0, taus * r, (taus - 1) * r)).sum(axis=0))
    np.testing.assert_allclose(loss(whole.coefficients), loss(plain.coefficients), rtol=1e-10)
    p.release()


def test_whole_process_falls_back_with_its_reason(table, monkeypatch):
    p = prepare("y ~ x + z", table, "g", "w", kernel_max_mb=1e-6)
    taus = np.array([0.2, 0.5, 0.9])
    monkeypatch.setattr(qr, "PROCESS_ROUNDS", 0)
    fit = qr.fit_process(p.groups[0], taus, "profn")
    assert "rows on the wrong side" in fit.info["process_fallback"] and fit.info["converged"]
    monkeypatch.setattr(qr, "_bands_once", lambda *a: (_ for _ in ()).throw(DecompositionError("more rows than fit")))
    again = qr.fit_process(p.groups[0], taus, "profn")
    assert again.info["process_fallback"] is not None
    local = LocalBlocks(*p.groups[0].gather(lambda b: (b.x, b.y, b.w)))
    np.testing.assert_allclose(fit.coefficients, qr.fit_process(local, taus, "br").coefficients, atol=1e-6)
    p.release()

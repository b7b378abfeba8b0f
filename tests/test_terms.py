"""Formula terms whose columns depend on the data, and the table function."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countershift import udtf
from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.operators.qr import fit_process
from countershift.plans.decompose import counterfactual_decompose as decompose
from countershift.sources.formula import compile_formula
from countershift.sources.prepare import prepare


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    d = pd.DataFrame({"x": np.concatenate([rng.exponential(size=380), np.repeat([0.5, 1.0], 10)]), "z": rng.normal(size=400), "g": np.arange(400) % 2, "f": np.array(["b", "a", "c", "b"])[np.arange(400) % 4], "k": np.arange(400) % 3})
    d["y"] = np.sin(d.x) + d.g + 0.1 * d.z
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in d.itertuples(index=False)] + [(None, 1.0, 1, "a", 1, 2.0), (float("nan"), 1.0, 0, "b", 2, 2.0)]
    return spark.createDataFrame(rows, "x double, z double, g int, f string, k int, y double").repartition(3).cache()


def columns(table, formula):
    design = compile_formula(formula, table)
    got = table.select("x", *[c.alias(f"c{k}") for k, (_, c) in enumerate(design.columns)]).toPandas()
    got = got[np.isfinite(got["x"])].sort_values("x")
    return got["x"].to_numpy(), got.drop(columns="x").to_numpy(float), [n for n, _ in design.columns]


def plain_splines(x, knots, degree):
    """The recursion, a value at a time."""

    def b(k, d, v):
        if d == 0:
            last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
            return float(knots[k] <= v and (v < knots[k + 1] or (k == last and v <= knots[k + 1])))
        out = 0.0
        if knots[k + d] > knots[k]:
            out += (v - knots[k]) / (knots[k + d] - knots[k]) * b(k, d - 1, v)
        if knots[k + d + 1] > knots[k + 1]:
            out += (knots[k + d + 1] - v) / (knots[k + d + 1] - knots[k + 1]) * b(k + 1, d - 1, v)
        return out

    return np.array([[b(k, degree, v) for k in range(len(knots) - degree - 1)] for v in x])


@pytest.mark.parametrize(("term", "degree", "inner"), [("bs(x, df = 6)", 3, 3), ("bs(x, 5, degree = 2)", 2, 3), ("bs(x, knots = c(0.5, 1))", 3, [0.5, 1.0]), ("bs(x)", 3, 0), ("bs(x, knots = 1, degree = 1)", 1, [1.0])])
def test_bsplines(table, term, degree, inner):
    x, got, names = columns(table, f"y ~ {term}")
    if isinstance(inner, int):
        inner = np.quantile(x, [(k + 1) / (inner + 1) for k in range(inner)]).tolist()
    expected = plain_splines(x, [x.min()] * (degree + 1) + inner + [x.max()] * (degree + 1), degree)
    np.testing.assert_allclose(got[:, 1:], expected[:, 1:], atol=1e-12)
    np.testing.assert_allclose(expected.sum(axis=1), 1)
    assert names[1:] == [f"{term}{k}" for k in range(1, expected.shape[1])]


def test_natural_splines(table):
    """As many columns as df; cubic inside, linear at both ends, and all such functions."""
    x, got, _ = columns(table, "y ~ ns(x, df = 4)")
    assert got.shape[1] == 5
    inner = np.quantile(x, [0.25, 0.5, 0.75])
    knots = np.array([x.min(), *inner, x.max()])
    cubic = lambda t: np.maximum(x[:, None] - t, 0) ** 3
    d = (cubic(knots[:-1]) - cubic(knots[-1:])) / (knots[-1] - knots[:-1])
    other = np.column_stack([np.ones(len(x)), x, d[:, :-1] - d[:, -1:]])  # the truncated-power basis of the same functions
    assert np.linalg.matrix_rank(got) == 5
    fitted = got @ np.linalg.lstsq(got, other, rcond=None)[0]
    np.testing.assert_allclose(fitted, other, atol=1e-8 * np.abs(other).max())


def test_scale_and_equal_cuts(table):
    x, got, names = columns(table, "y ~ scale(x) + cut(x, 3)")
    np.testing.assert_allclose(got[:, 1], (x - x.mean()) / x.std(ddof=1), atol=1e-12)
    edges = np.linspace(x.min(), x.max(), 4)
    np.testing.assert_array_equal(got[:, 2:], np.column_stack([(x > edges[k]) & (x <= (edges[k + 1] if k < 2 else np.inf)) for k in (1, 2)]))
    assert names[1] == "scale(x)" and names[2].startswith("cut(x, 3)(")


@pytest.mark.parametrize("term", ["bs(x, df = 2)", "bs(x, df = 4, knots = 1)", "bs(x, knots = 99)", "ns(x, degree = 2)", "bs(x, degree = 9)", "scale(x, 2)", "cut(x, 1)", "cut(x, 2.5)", "cut(x)", "bs(g - g)"])
def test_terms_that_can_not_be(table, term):
    with pytest.raises(DecompositionError):
        compile_formula(f"y ~ {term}", table)


def test_decomposition_with_splines(table):
    near, far = (decompose("y ~ bs(x, df = 4) + f", table, "g", None, "loc", control=Control(nreg=20, kernel_max_mb=mb)) for mb in (64, 1e-6))
    for e in near.point.effects:
        np.testing.assert_allclose(near.point.effects[e], far.point.effects[e], atol=1e-7)


def test_alternating_directions_are_refused_on_executors(table):
    p = prepare("y ~ x", table, "g", None, kernel_max_mb=1e-6)
    with pytest.raises(DecompositionError, match="in memory"):
        fit_process(p.groups[0], [0.5], "cuda_admm", Control())
    p.release()


def test_table_function_by_partition(spark, table):
    udtf.register(spark)
    table.createOrReplaceTempView("cf_keys")
    found = spark.sql("SELECT * FROM cf_decompose(TABLE(cf_keys) PARTITION BY (k), 'y ~ x + f', 'g', '', 'loc', 'k')")
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("k", "int"), ("effect", "string"), ("quantile", "double"), ("estimate", "double")]
    rows = found.collect()
    assert len(rows) == 3 * 27
    for k in range(3):
        direct = decompose("y ~ x + f", table.where(F.col("k") == k), "g", None, "loc").point.effects
        for r in rows:
            if r["k"] == k:
                assert r["estimate"] == pytest.approx(direct[r["effect"]][round(r["quantile"] * 10) - 1], abs=1e-9)
    one_sided = spark.sql("SELECT * FROM cf_decompose(TABLE(SELECT * FROM cf_keys WHERE g = 1) PARTITION BY (k), 'y ~ x', 'g', '', 'loc', 'k')")
    assert one_sided.collect() == []
    with pytest.raises(Exception, match="no columns"):
        spark.sql("SELECT * FROM cf_decompose(TABLE(cf_keys) PARTITION BY (k), 'y ~ nothing', 'g', '', 'loc', 'k')").collect()

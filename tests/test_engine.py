"""The engine on Spark: modes agree, invariances, preparation, bootstrap, files, registry, SQL."""

import json
import math
import os
import pickle
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import countershift as cs
from countershift import cli, queries, registry, result, udtf
from countershift.control import Control
from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.operators.exact import exact_sums, exact_totals
from countershift.plans.bootstrap import multipliers, resample_frame, resolve_engine, signature
from countershift.plans.decompose import counterfactual_decompose as decompose
from countershift.sources.formula import compile_formula
from countershift.sources.prepare import prepare, subsample
from countershift.sources.readers import read_table
from countershift.sources.sinks import write_together
from countershift.sources.synthetic import scenario_table

SMALL = Control(nreg=12)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 700
    d = pd.DataFrame({"x1": rng.normal(size=n), "x2": rng.integers(0, 2, n).astype(float), "group": np.arange(n) % 2, "weight": rng.uniform(0.5, 2, n)})
    d["y"] = 1 + 0.5 * d.x1 + 0.3 * d.x2 + d.group * (0.4 + 0.2 * d.x1) + rng.normal(size=n)
    d["cy"], d["rc"] = np.maximum(-0.8, d.y), np.minimum(2.5, d.y)
    d["duration"], d["event"], d["kind"], d["flag"] = np.exp(d.y / 2), (rng.uniform(size=n) < 0.8).astype(int), np.where(d.x2 == 1, "b", "a"), d.x2 == 1
    return spark.createDataFrame(d).repartition(3).cache()


CASES = {
    "loc": ("y", {}), "locsca": ("y", {}), "lpm": ("y", {}), "logit": ("y", {}), "probit": ("y", {}), "cloglog": ("y", {}), "qr": ("y", {}),
    "cox": ("duration", {"event": "event"}), "cqr": ("cy", {"censoring": -0.8}),
}


@pytest.mark.parametrize("model", CASES)
def test_modes_agree_and_identity_holds(data, model):
    y, more = CASES[model]
    control = dict(nreg=6)
    formula = f"{y} ~ x1" if model == "cqr" else f"{y} ~ x1 + x2"
    one = decompose(formula, data, "group", "weight", model, control=Control(**control), **more)
    other = decompose(formula, data, "group", "weight", model, control=Control(kernel_max_mb=1e-6, **control), **more)
    assert (one.metadata["execution_mode"], other.metadata["execution_mode"]) == ("kernel", "distributed")
    for e, v in one.point.effects.items():
        np.testing.assert_allclose(v, other.point.effects[e], atol=1e-6)
    assert one.point.residual < 1e-10


@pytest.mark.parametrize("model", ["loc", "locsca", "logit", "qr"])
def test_invariances(data, model):
    a = decompose("y ~ x1 + kind", data, "group", "weight", model, control=SMALL).point.effects
    b = decompose("y ~ x1 + kind", data.withColumn("weight", F.col("weight") * 1000), "group", "weight", model, control=SMALL).point.effects
    c = decompose("y ~ 1", data, "group", "weight", model, control=SMALL).point.effects
    for e in a:
        np.testing.assert_allclose(a[e], b[e], atol=1e-9)
    np.testing.assert_allclose(c["composition"], 0, atol=1e-12)


def test_censored_from_either_side(data):
    left = decompose("cy ~ x1", data, "group", "weight", "cqr", control=Control(nreg=5), censoring=-0.8)
    mirrored = data.withColumn("m", -F.col("cy"))
    right = decompose("m ~ x1", mirrored, "group", "weight", "cqr", control=Control(nreg=5, cqr_right=True), censoring=0.8)
    np.testing.assert_allclose(left.point.fits[0].coefficients, -right.point.fits[0].coefficients[:, ::-1], atol=1e-8)
    with pytest.raises(NotIdentifiedError):
        decompose("y ~ x1", data, "group", "weight", "cqr", censoring=-100.0)
    with pytest.raises(DecompositionError):
        decompose("y ~ x1", data, "group", "weight", "cqr")
    with pytest.raises(DecompositionError):
        decompose("cy ~ x1", data, "group", "weight", "cqr", solver="onestep", censoring=-0.8)


def test_preparation(spark, data):
    rows = data.withColumn("x1", F.when(F.col("x1") > 2.2, float("inf")).when(F.col("x1") < -2.2, float("nan")).otherwise(F.col("x1")))
    kept = data.where("x1 between -2.2 and 2.2").count()
    p = prepare("y ~ x1 + kind + x1:kind + I(x1^2) + log(duration)", rows, "group", "weight")
    assert p.n == kept and p.omitted_rows == data.count() - kept
    assert p.columns == ["(Intercept)", "x1", "kindb", "I(x1^2)", "log(duration)", "x1:kindb"]
    with pytest.warns(UserWarning, match="dropped"):
        q = prepare("y ~ x1 + x2 + kind + flag", data, "group", "weight")
    assert len(q.columns) == 3
    assert subsample(q, 100, 3).n == 100
    for bad in ("y ~ x1 + offset(x2)", "y ~ x1 - 1", "kind ~ x1", "y ~ nothing", "y ~ 0 + x1", "y", "y ~ (x1"):
        with pytest.raises(DecompositionError):
            prepare(bad, data, "group")
    for group in (F.col("x1"), F.lit(1)):
        with pytest.raises(DecompositionError):
            prepare("y ~ x1", data, group)
    with pytest.raises(DecompositionError):
        prepare("y ~ x1", data, "group", F.col("x1"))
    assert prepare("y ~ x1", data.withColumn("g", F.col("group").cast("string")), "g").n == data.count()


def test_extreme_designs(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i), i % 2, 10.0 ** (i % 30 - 15)) for i in range(60)], "y double, x double, g int, w double")
    out = decompose("y ~ x", rows, "g", "w", "loc", control=SMALL)
    assert np.isfinite(out.point.effects["total"]).all()
    constant = rows.withColumn("y", F.when(F.col("g") == 0, 1.0).otherwise(F.col("y")))
    out = decompose("y ~ x", constant, "g", None, "lpm", control=Control(nreg=9))
    assert [len(f.grid) for f in out.point.fits][0] == 1


def test_bootstrap_resumes_and_extends(data, tmp_path):
    run = lambda reps, **k: decompose("y ~ x1", data, "group", "weight", "loc", control=SMALL, bootstrap_reps=reps, checkpoint_dir=str(tmp_path), seed=9, **k)
    first = run(4)
    folder = next(tmp_path.iterdir())
    broken = folder / "rep_000002.json"
    broken.write_text("{")
    second = run(6)
    for e in first.draws:
        np.testing.assert_array_equal(first.draws[e], second.draws[e][:4])
    assert len(second.tests) == 12 and second.reps == 6 and json.loads(broken.read_text())["replication"] == 2
    assert {r["bootstrap_reps_effective"] for r in second.rows()} == {6}


@pytest.mark.parametrize("scheme", ["counterfactual", "empirical", "multiplier"])
def test_bootstrap_schemes_and_engines(data, scheme):
    assert multipliers(np.random.default_rng(1), 50, scheme).sum() == (50 if scheme != "multiplier" else pytest.approx(50, rel=0.6))
    make = lambda engine, solver: decompose("y ~ x1", data, "group", "weight", "qr", solver, Control(nreg=25, bootstrap_scheme=scheme, qr_bootstrap_engine=engine), bootstrap_reps=3, seed=4)
    a, b = make("standard", "pfnb"), make("xy_preprocess", "pfnb")
    for e in a.draws:
        np.testing.assert_allclose(a.draws[e], b.draws[e], atol=1e-6)
    assert np.isfinite(make("onestep", "onestep").draws["total"]).all()
    with pytest.raises(DecompositionError):
        resolve_engine("qr", "pfnb", Control(qr_bootstrap_engine="onestep"))


def test_distributed_resample(data):
    p = prepare("y ~ x1", data, "group", "weight", kernel_max_mb=1e-6)
    drawn = resample_frame(p.groups[0], "counterfactual", 5, 0)
    again = resample_frame(p.groups[0], "counterfactual", 5, 0)
    assert drawn.total == p.groups[0].rows and drawn.rows < drawn.total
    assert drawn.frame.agg(F.sum("w")).first() == again.frame.agg(F.sum("w")).first()
    out = decompose("y ~ x1", data, "group", "weight", "loc", control=Control(nreg=6, kernel_max_mb=1e-6), bootstrap_reps=2)
    assert out.draws["total"].shape == (2, 9)
    p.release()


LAYOUTS = (2, 3, 5, 7, 11)


def test_distributed_draws_do_not_depend_on_the_layout(data):
    """Row for row and bit by bit: mean weight, resamples, subsamples and signatures."""
    seen = []
    for n in LAYOUTS:
        p = prepare("y ~ x1", data.union(data).repartition(n), "group", "weight", kernel_max_mb=1e-6)
        rows = [p.mean_weight, signature(p, "loc", None, Control(), "standard", 1, "y ~ x1")]
        for scheme in ("counterfactual", "empirical", "multiplier"):
            drawn = resample_frame(p.groups[1], scheme, 9, 1)
            rows.append((drawn.total, sorted(map(tuple, drawn.frame.select(*drawn.names).collect()))))
        rows.append(sorted(map(tuple, subsample(p, 200, 3).groups[0].frame.select("x_1", "y", "w").collect())))
        seen.append(rows)
        p.release()
    assert all(x == seen[0] for x in seen[1:])


def test_draws_in_memory_do_not_depend_on_the_layout(data, tmp_path):
    seen = []
    for n in LAYOUTS[:3]:
        p = prepare("y ~ x1", data.union(data).repartition(n), "group", "weight")
        taken = subsample(p, 200, 3).groups[0].block
        seen.append((p.mean_weight, signature(p, "loc", None, Control(), "standard", 1, "y ~ x1"), *(v.tobytes() for v in (*p.groups[0].block, *taken))))
    assert seen[0] == seen[1] == seen[2]
    make = lambda frame, reps: decompose("y ~ x1", frame, "group", "weight", "loc", control=Control(nreg=6), bootstrap_reps=reps, checkpoint_dir=str(tmp_path))
    two, four, fresh = make(data.repartition(3), 2), make(data.repartition(5), 4), decompose("y ~ x1", data.repartition(7), "group", "weight", "loc", control=Control(nreg=6), bootstrap_reps=4)
    assert two.metadata["bootstrap_signature"] == four.metadata["bootstrap_signature"] == fresh.metadata["bootstrap_signature"]
    np.testing.assert_array_equal(four.draws["total"], fresh.draws["total"])


def test_exact_sums(spark):
    """Against exact rational sums, for doubles of every size, in several layouts."""
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 2.0**52, 1 / 3, 8.0, float(np.nextafter(8.0, 0)), 2.0**1020, -(2.0**-1070)]
    values += (rng.normal(size=400) * 10.0 ** rng.integers(-300, 290, 400)).tolist() + (rng.random(300) * 100).tolist()
    rows = [(None if k % 7 == 0 else k % 3, None if k % 50 == 49 else v) for k, v in enumerate(values)] + [(9, None)]
    expected = {}
    for k, v in rows:
        if v is not None:
            expected[k] = expected.get(k, Fraction(0)) + Fraction(v)
    for n in LAYOUTS:
        frame = spark.createDataFrame(rows, "k int, v double").repartition(n)
        found = {r["k"]: r["exact_sum"] for r in exact_sums(frame, ["k"], "v").collect()}
        assert found == {k: float(v) if abs(v) < 2**1024 - 2**970 else (math.inf if v > 0 else -math.inf) for k, v in expected.items()}
        assert {k: t for k, (_, t) in exact_totals(frame, "k", "v").items()} == expected
    assert exact_sums(spark.createDataFrame([], "k int, v double"), ["k"], "v").collect() == []


def test_distributed_bootstrap_resumes_on_another_layout(data, tmp_path):
    make = lambda frame, **more: decompose("y ~ x1", frame, "group", "weight", "loc", control=Control(nreg=6, kernel_max_mb=more.pop("mb", 1e-6)), checkpoint_dir=str(tmp_path), **more)
    two = make(data.repartition(3), bootstrap_reps=2)
    three = make(data.repartition(5), bootstrap_reps=3)
    np.testing.assert_allclose(three.draws["total"][:2], two.draws["total"])
    assert three.metadata["bootstrap_signature"] == two.metadata["bootstrap_signature"]
    assert make(data, bootstrap_reps=2, mb=64).metadata["bootstrap_signature"] != two.metadata["bootstrap_signature"]


def test_distributed_engines_equal_those_in_memory(data):
    """The same resample refitted by each engine on executors and in memory."""
    from countershift.operators.blocks import LocalBlocks
    from countershift.operators.qr import fit_process
    from countershift.plans import bootstrap

    p = prepare("y ~ x1", data, "group", "weight", kernel_max_mb=1e-6)
    taus = [0.42, 0.46, 0.5, 0.54, 0.58]
    point = fit_process(p.groups[0], taus, "onestep", Control())
    drawn = resample_frame(p.groups[0], "counterfactual", 3, 0)
    x, y, w, freq = drawn.gather(lambda b: (b.x, b.y, b.w, b.freq))
    local = LocalBlocks(x, y, w, freq, np.zeros(len(y)), np.ones(len(y)))
    np.testing.assert_allclose(bootstrap._onestep_passes(drawn, point, Control()).coefficients, bootstrap._onestep(local, point).coefficients, atol=1e-6)
    np.testing.assert_allclose(fit_process(drawn, taus, "pfn").coefficients, bootstrap._xy(local, point).coefficients, atol=1e-6)
    out = decompose("y ~ x1", data, "group", "weight", "qr", "onestep", control=Control(nreg=25, kernel_max_mb=1e-6, qr_bootstrap_engine="onestep"), bootstrap_reps=2)
    assert out.metadata["bootstrap_engine"] == "onestep" and np.isfinite(out.draws["total"]).all()
    p.release()


def test_tables_files_and_plot(spark, data, tmp_path):
    out = decompose("y ~ x1 + x2", data, "group", "weight", "qr", control=Control(nreg=10, quantile_noncrossing="rearrange"), bootstrap_reps=3)
    table = result.decomposition_table(spark, out)
    assert table.columns[:4] == ["model", "solver", "quantile", "effect"] and table.count() == 27
    assert result.marginalization_table(spark, out).count() == 3 and result.crossing_table(spark, out).count() == 6
    assert result.observed_table(spark, out).count() == 9 and result.tests_table(spark, out).count() == 12 and result.draws_table(spark, out).count() == 81
    assert result.coefficient_table(spark, out).count() == 2 * 10 * 3
    assert len(result.summary(out, ["total"], [0.11, 0.52])) == 2 and "observations" in repr(out)
    rows, svg = result.plot(out, str(tmp_path / "p.svg"), "uniform")
    assert len(rows) == 27 and svg.startswith("<svg")
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "mine.txt").write_text("stays")
    made = cs.write_cf_outputs(out, str(tmp_path / "o"))
    assert set(result.REQUIRED) <= set(made) and (tmp_path / "o" / "mine.txt").exists()
    with open(tmp_path / "o" / "fit.pkl", "rb") as f:
        assert pickle.load(f).model == "qr"
    plain = decompose("y ~ x1", data, "group", "weight", "loc", control=SMALL)
    cs.write_cf_outputs(plain, str(tmp_path / "o"))
    assert not (tmp_path / "o" / "bootstrap_resources.csv").exists()


def test_transactions(tmp_path):
    folder = str(tmp_path / "t")
    write_together(folder, ["a"], lambda s: open(os.path.join(s, "a"), "w").write("1"), ["a"])
    for managed, required, names in ((["a", "b"], ["b"], ["a"]), (["a"], [], ["a", "x"])):
        with pytest.raises(DecompositionError):
            write_together(folder, managed, lambda s, names=names: [open(os.path.join(s, n), "w").write("2") for n in names], required)
    assert (tmp_path / "t" / "a").read_text() == "1" and os.listdir(folder) == ["a"]
    with pytest.raises(DecompositionError):
        write_together(folder, ["../a"], lambda s: None, [])


def test_registry(spark, data):
    offset = 0.0

    def solve(x, y, w, taus):
        from countershift.operators.qrkernel import exact

        return np.column_stack([exact(x * w[:, None], y * w, t)[0] for t in taus]) + offset

    cs.register_qr_solver("Own.solver", solve, exact=True)
    try:
        before = registry.active_fingerprint("own.solver", "auto", "auto")
        offset = 5.0
        a = decompose("y ~ x1", data, "group", "weight", "qr", "own.solver", SMALL).point.effects["total"]
        b = decompose("y ~ x1", data, "group", "weight", "qr", "br", SMALL).point.effects["total"]
        np.testing.assert_allclose(a, b, atol=1e-8)
        with pytest.raises(DecompositionError):
            cs.register_qr_solver("own.solver", solve, exact=True)
        cs.register_qr_solver("own.solver", solve, exact=True, overwrite=True)
        assert registry.active_fingerprint("own.solver", "auto", "auto") != before
        assert cs.qr_solver_registry(spark).where("solver = 'own.solver'").count() == 1
    finally:
        assert cs.unregister_qr_solver("own.solver") and not cs.unregister_qr_solver("own.solver", quiet=True)
    for name in ("br", "1x", "auto"):
        with pytest.raises(DecompositionError):
            cs.register_qr_solver(name, solve, exact=True)
    cs.register_conditional_backend("mine", "linear", lambda x, z, w: np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0])
    try:
        a = decompose("y ~ x1", data, "group", "weight", "loc", control=Control(nreg=12, linear_backend="mine")).point.effects["total"]
        b = decompose("y ~ x1", data, "group", "weight", "loc", control=Control(nreg=12, linear_backend="chol")).point.effects["total"]
        np.testing.assert_allclose(a, b, atol=1e-10)
    finally:
        cs.unregister_conditional_backend("mine", "linear")
    assert cs.conditional_backend_registry(spark).count() > 10 and not cs.gpu_backend_status()["available"]


def test_benchmarks(data, tmp_path):
    raw, table = cs.benchmark_qr_solvers_repeated("y ~ x1", data, "group", "weight", ("br", "pfnb"), control=SMALL, repetitions=2)
    assert len(raw) == 6 and table["failures"].sum() == 0 and table["max_abs_effect_difference"].max() < 1e-8
    backends = cs.benchmark_conditional_backends("y ~ x1", data, "group", "weight", "loc", control=SMALL)
    assert backends["max_abs_effect_difference"].max() < 1e-9
    path = str(tmp_path / "scaling.json")
    first, _ = cs.benchmark_qr_scaling("y ~ x1", data, "group", "weight", ("br",), control={"nreg": 5}, sample_sizes=(100, 200), checkpoint_path=path)
    again, table = cs.benchmark_qr_scaling("y ~ x1", data, "group", "weight", ("br",), control={"nreg": 5}, sample_sizes=(100, 200), checkpoint_path=path)
    assert first["elapsed_sec"].tolist() == again["elapsed_sec"].tolist() and table["peak_rss_mb"].min() > 0


def test_simulation(spark, tmp_path):
    run = lambda n: cs.simulate_counterfactual_validation(spark, n, 200, nreg=9, bootstrap_reps=3, checkpoint_dir=str(tmp_path / "c"))
    first, second = run(1), run(2)
    assert len(second.summary) == 27 and len(second.curve_coverage) == 9 and second.raw["identity_residual"].max() < 1e-10
    same = second.raw[second.raw.replication == 1].reset_index(drop=True)
    np.testing.assert_array_equal(first.raw["estimate"], same["estimate"])
    assert "simulation_summary.csv" in cs.write_simulation_validation(second, str(tmp_path / "o"))
    assert scenario_table(spark, "location_shift", 1000, partitions=3).groupBy("group").count().where("count = 1000").count() == 2


def test_command_line(spark, data, tmp_path):
    path = str(tmp_path / "d.csv")
    data.select("y", "x1", "group", "weight").toPandas().to_csv(path, index=False)
    assert read_table(spark, path).count() == data.count()
    out = str(tmp_path / "out")
    base = ["--data", path, "--formula", "y ~ x1", "--group", "group", "--weights", "weight"]
    assert cli.main(["decompose", *base, "--output", out, "--model", "loc", "--nreg", "10"], spark) == 0
    assert os.path.exists(os.path.join(out, "decomposition.csv"))
    with pytest.raises(DecompositionError):
        cli.main(["decompose", *base, "--output", path], spark)
    with pytest.raises(SystemExit):
        cli.main(["decompose", *base, "--outputs", out], spark)
    assert cli.main(["benchmark", *base, "--output", str(tmp_path / "b"), "--nreg", "5", "--repetitions", "1"], spark) == 0


def test_table_function(spark, data):
    udtf.register(spark)
    data.select("y", "x1", "group", "weight").createOrReplaceTempView("cf_data")
    rows = spark.sql("SELECT * FROM cf_decompose(TABLE(cf_data) WITH SINGLE PARTITION, 'y ~ x1', 'group', 'weight', 'loc')").collect()
    direct = decompose("y ~ x1", data, "group", "weight", "loc").point.effects
    assert len(rows) == 27
    for r in rows:
        assert r["estimate"] == pytest.approx(direct[r["effect"]][round(r["quantile"] * 10) - 1], abs=1e-9)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    if name == "dr_thresholds" or name.endswith("saturated_decomp"):
        sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{sf_dir}/{table}'")
    expected = con.execute(queries.ORACLE_SQL[name]).df()
    found = queries.QUERIES[name](spark, sf_dir).toPandas()[list(expected.columns)]
    keys = [c for c in expected.columns if expected[c].dtype == object or expected[c].dtype.kind in "iu" or str(expected[c].dtype).startswith("str") or c in ("p", "quantile", "t", "grid_value")]
    a, b = (f.sort_values(keys or list(f.columns), ignore_index=True) for f in (found, expected))
    assert len(a) == len(b)
    for c in expected.columns:
        if b[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c], rtol=1e-9, atol=1e-6)
        else:
            assert a[c].tolist() == b[c].tolist()


def test_wide_terms(spark):
    rng = np.random.default_rng(0)
    table = pd.DataFrame({"y": rng.normal(size=200), "x": rng.integers(0, 30, 200).astype(float), "z": rng.normal(size=200), "f": rng.choice(["a", "b"], 200)})
    frame = spark.createDataFrame(table)

    def columns(formula):
        design = compile_formula(formula, frame)
        out = frame.select("y", *[c.alias(f"c{k}") for k, (_, c) in enumerate(design.columns)]).toPandas()
        assert np.allclose(out.y, table.y)
        return {n: out[f"c{k}"].to_numpy() for k, (n, _) in enumerate(design.columns)}

    x, z = table.x.to_numpy(), table.z.to_numpy()
    found = columns("y ~ I(x > 10 & z <= 0) + f:I(x > 3)")
    assert np.array_equal(found["I(x > 10 & z <= 0)TRUE"], ((x > 10) & (z <= 0)).astype(float)) and "I(x > 10 & z <= 0)FALSE" not in found
    assert {"fa:I(x > 3)FALSE", "fb:I(x > 3)TRUE"} <= set(found)
    found = columns("y ~ cut(x, c(-1, 9, 19, Inf))")
    assert list(found) == ["(Intercept)", "cut(x, c(-1, 9, 19, Inf))(9,19]", "cut(x, c(-1, 9, 19, Inf))(19,Inf]"]
    assert np.array_equal(found["cut(x, c(-1, 9, 19, Inf))(9,19]"], ((x > 9) & (x <= 19)).astype(float))
    found = columns("y ~ cut(x, c(5, 9, 19)) + z")
    assert np.array_equal(np.isnan(found["cut(x, c(5, 9, 19))(9,19]"]), (x <= 5) | (x > 19))
    found = columns("y ~ poly(x, 3)")
    q = np.column_stack([found[f"poly(x, 3){k}"] for k in (1, 2, 3)])
    np.testing.assert_allclose(q.T @ q, np.eye(3), atol=1e-9)
    np.testing.assert_allclose(q.sum(axis=0), 0, atol=1e-9)
    basis = np.column_stack([np.ones(200), x, x**2, x**3])
    np.testing.assert_allclose(basis @ np.linalg.lstsq(basis, q, rcond=None)[0], q, atol=1e-8)
    found = columns("y ~ poly(x, 2, raw = TRUE) + pmin(x, 5) + ifelse(z > 0, x, -1) + log10(1 + x)")
    np.testing.assert_allclose(found["poly(x, 2, raw = TRUE)2"], x**2)
    np.testing.assert_allclose(found["ifelse(z > 0, x, -1)"], np.where(z > 0, x, -1))
    np.testing.assert_allclose(found["pmin(x, 5)"], np.minimum(x, 5))
    for bad in ("y ~ poly(x, 0)", "y ~ cut(x, 1)", "y ~ poly(f, 2)", "y ~ ifelse(x, 1, 2)"):
        with pytest.raises(DecompositionError):
            columns(bad)


def test_every_control_has_a_flag():
    line = ["decompose", "--data", "d", "--formula", "y ~ x", "--group", "g", "--output", "o"]
    a = cli.parser().parse_args([*line, "--qr-bootstrap-engine", "xy_preprocess", "--bootstrap-max-retries", "5", "--dr-tolerance", "1e-6", "--marginal-method", "chunked", "--legacy-weighted-quantile", "true", "--cqr-nsteps", "4", "--kernel-max-mb", "8"])
    assert (a.qr_bootstrap_engine, a.bootstrap_max_retries, a.dr_tolerance, a.legacy_weighted_quantile, a.cqr_nsteps, a.kernel_max_mb) == ("xy_preprocess", 5, 1e-6, True, 4, 8.0)
    plain = cli.parser().parse_args(line)
    assert all(getattr(plain, f.name) == getattr(Control(), f.name) for f in cli.control_fields())


def test_checkpoints_and_outputs_on_any_file_system(spark, data, tmp_path):
    """Paths with a scheme go through Hadoop's file systems."""
    place = f"file://{tmp_path}/remote"
    make = lambda reps: decompose("y ~ x1", data, "group", "weight", "loc", control=SMALL, bootstrap_reps=reps, checkpoint_dir=f"{place}/run")
    two, three = make(2), make(3)
    np.testing.assert_array_equal(three.draws["total"][:2], two.draws["total"])
    folder = tmp_path / "remote" / "run" / f"run_{two.metadata['bootstrap_signature']}"
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == [f"rep_{r:06d}.json" for r in (1, 2, 3)]
    (folder / "rep_000002.json").write_text("{}")
    np.testing.assert_array_equal(make(2).draws["total"], two.draws["total"])
    made = result.write_outputs(three, f"{place}/out")
    assert result.write_outputs(three, f"{place}/out") == made and set(made) <= {p.name for p in (tmp_path / "remote" / "out").iterdir()}

    def broken(stage):
        raise ValueError("no")

    before = (tmp_path / "remote" / "out" / made[0]).read_bytes()
    with pytest.raises(ValueError):
        write_together(f"{place}/out", made, broken, made)
    assert (tmp_path / "remote" / "out" / made[0]).read_bytes() == before
    assert not [p for p in (tmp_path / "remote" / "out").iterdir() if p.is_dir()]


def test_survival_on_executors_equals_memory(spark):
    """Heavily tied and all-distinct times, no event behind a time, one time for all; the driver sees answers only."""
    from countershift.operators.cox import HazardArrays, HazardTable, cox_quantiles, fit_cox, km_blocks

    rng = np.random.default_rng(12)
    n = 1200
    for times in (rng.integers(1, 9, n).astype(float), rng.exponential(size=n), np.where(rng.uniform(size=n) < 0.4, 2.5, rng.exponential(size=n) * 3)):
        d = pd.DataFrame({"t": times, "x": rng.integers(0, 2, n).astype(float), "e": (rng.uniform(size=n) < 0.7).astype(int), "g": np.arange(n) % 2, "w": rng.uniform(0.5, 2, n)})
        table = spark.createDataFrame(d).repartition(5)
        near, far = (prepare("t ~ x", table, "g", "w", "cox", event="e", kernel_max_mb=mb) for mb in (64, 1e-6))
        probs = [0.05, 0.2, 0.5, 0.7, 0.95]
        for a, b in zip(near.groups, far.groups):
            for boundary in ("na", "cap"):
                np.testing.assert_array_equal(km_blocks(a, probs, boundary), km_blocks(b, probs, boundary))
            one, two = fit_cox(a, Control()), fit_cox(b, Control())
            assert isinstance(one.baseline, HazardArrays) and isinstance(two.baseline, HazardTable)
            np.testing.assert_allclose(one.coefficients, two.coefficients, atol=1e-8)
            for other, blocks in zip(near.groups, far.groups):
                x, y = cox_quantiles(one, other, probs, "na"), cox_quantiles(two, blocks, probs, "na")
                np.testing.assert_array_equal(x[0], y[0])
                np.testing.assert_allclose(x[2], y[2], rtol=1e-9)
            stored = pickle.loads(pickle.dumps(two))
            np.testing.assert_allclose(stored.baseline.hazard, one.baseline.hazard, rtol=1e-7)
            two.release()
        far.release()


def test_hazards_between(spark):
    from countershift.operators.cox import HazardArrays, HazardTable

    hazard = np.cumsum(np.random.default_rng(3).exponential(size=500))
    arrays = HazardArrays(np.arange(500.0), hazard)
    table = HazardTable(spark.createDataFrame(pd.DataFrame({"time": np.arange(500.0), "hazard": hazard})).repartition(3))
    assert arrays.ends() == table.ends()
    for lo, hi in ((0.0, hazard[-1]), (hazard[3], hazard[5]), (hazard[3], hazard[4]), (hazard[10], hazard[30])):
        a, b = (k.between([(lo, hi), (lo, lo)], 16) for k in (arrays, table))
        inside = hazard[(hazard > lo) & (hazard < hi)]
        for found in (a[0], b[0]):
            assert set(found) <= set(inside) and (len(found) >= min(len(inside), 3)) and found == sorted(found)
        assert a[1] == b[1] == []
    assert arrays.first([hazard[7], hazard[7] + 1e-12]) == table.first([hazard[7], hazard[7] + 1e-12]) == [7.0, 8.0]

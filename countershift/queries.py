"""Registered queries of the decomposition engine and their SQL counterparts, over the order and event tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countershift import result as R
from countershift.control import Control
from countershift.functions.curves import normal_quantile
from countershift.operators import frame as ops
from countershift.operators.cox import HazardTable, cox_quantiles, kaplan_meier, km_blocks
from countershift.operators.exact import exact_sums
from countershift.operators.models import Fit
from countershift.plans.decompose import counterfactual_decompose
from countershift.plans.simulate import RAW, summarise
from countershift.sources.prepare import prepare, subsample
from countershift.sources.synthetic import SCENARIOS
from countershift.streaming.moments import moments, solve

# ---- inputs ----------------------------------------------------------------------------------

PRICE = """SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS g, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w,
 CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2, l_returnflag AS f FROM lineitem"""
ORDER = """SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS g, CAST(o_totalprice AS DOUBLE) AS y, CAST(1 + o_custkey % 7 AS DOUBLE) AS w,
 o_orderpriority AS f FROM orders WHERE o_orderstatus IN ('O', 'F')"""
#: Weights of which no sum is a level's share of another, so that quantiles are unique.
UNEVEN = f"SELECT g, y, sqrt(w) AS w, f FROM ({ORDER})"
JOINED = """SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS g, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, c_mktsegment AS f
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
#: Keys that are decomposed side by side: the order priorities.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: The quantiles that are reported by default.
NINE = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SEGMENTS = """SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS g, CAST(o_totalprice AS DOUBLE) AS y, CAST(1 + o_custkey % 7 AS DOUBLE) AS w,
 concat('c', CAST(o_custkey % 3 AS STRING)) AS f, o_orderpriority AS k FROM orders WHERE o_orderstatus IN ('O', 'F')"""
#: A covariate of eleven values, as one of eleven levels.
LEVELS = PRICE.replace("l_returnflag AS f", "CAST(round(l_discount * 100) AS INT) AS f")
DURATION = """SELECT CAST(user_id % 2 AS INT) AS g, CAST(value AS DOUBLE) AS y, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS event,
 CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS x1, CAST(1 + event_id % 5 AS DOUBLE) AS w, event_id AS k FROM events"""
CENSORED = """SELECT CAST(c_nationkey % 2 AS INT) AS g, greatest(CAST(c_acctbal AS DOUBLE), CAST(0 AS DOUBLE)) AS y, CAST(0 AS DOUBLE) AS cens,
 c_mktsegment AS f, CAST(1 + c_custkey % 4 AS DOUBLE) AS w FROM customer"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the inputs above over the Parquet tables it names."""
    for table in ("lineitem", "orders", "customer", "events"):
        if table in sql.split("FROM", 1)[1]:
            sql = sql.replace(f" {table}", f" parquet.`{sf_dir}/{table}.parquet`") if f"{table} JOIN" not in sql and "JOIN" not in sql else sql
    if "JOIN" in sql:
        for table in ("lineitem", "orders", "customer"):
            sql = sql.replace(f" {table} ", f" parquet.`{sf_dir}/{table}.parquet` ")
    return spark.sql(sql)


# ---- SQL pieces ------------------------------------------------------------------------------

EPS64 = "64 * 2.220446049250313e-16"


def _values(probs) -> str:
    return ", ".join(f"(CAST({p!r} AS DOUBLE))" for p in probs)


def _type7(rel: str, probs, name: str, key: str = "g") -> str:
    """CTEs ending in ``name(key, p, q)`` for a relation with columns key, v, w, n (values that count as one)."""
    return f"""{name}_a AS (SELECT {key}, v, sum(w) AS w, sum(n) AS n FROM {rel} GROUP BY {key}, v),
 {name}_c AS (SELECT {key}, v, sum(w) OVER (PARTITION BY {key} ORDER BY v) AS cw, sum(w) OVER (PARTITION BY {key}) AS tw, CAST(sum(n) OVER (PARTITION BY {key}) AS DOUBLE) AS n FROM {name}_a),
 {name}_p AS (SELECT p, 1 + (n - 1) * p AS pos, n, {key} FROM (SELECT DISTINCT {key}, n FROM {name}_c), (VALUES {_values(probs)}) t(p)),
 {name}_r AS (SELECT *, greatest(floor(pos), 1) AS lo, least(greatest(floor(pos), 1) + 1, n) AS hi FROM {name}_p),
 {name} AS (SELECT r.{key}, r.p,
   (1 - (pos - floor(pos))) * coalesce(min(v) FILTER (cw * r.n / tw >= lo - {EPS64} * greatest(1, r.n)), max(v))
   + (pos - floor(pos)) * coalesce(min(v) FILTER (cw * r.n / tw >= hi - {EPS64} * greatest(1, r.n)), max(v)) AS q
  FROM {name}_r r JOIN {name}_c c ON r.{key} = c.{key} GROUP BY r.{key}, r.p, pos, lo, hi)"""


def _effects(levels: str, digits: int = 4) -> str:
    """Effects from a relation (d, p, q) with d 0: reference, 1: counterfactual, 2: comparison."""
    pick = lambda d: f"max(q) FILTER (d = {d})"
    return f"""SELECT effect, quantile, round(estimate, {digits}) + 0 AS estimate FROM (
 SELECT 'structure' AS effect, p AS quantile, {pick(2)} - {pick(1)} AS estimate FROM {levels} GROUP BY p
 UNION ALL SELECT 'composition', p, {pick(1)} - {pick(0)} FROM {levels} GROUP BY p
 UNION ALL SELECT 'total', p, {pick(2)} - {pick(0)} FROM {levels} GROUP BY p)"""


def _decomposed(formula: str, sql: str, model: str, probs, nreg: int, weights: str = "w", digits: int = 4, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        control = Control(nreg=nreg, trimming=0.0, reported_quantiles=tuple(probs), **more.get("control", {}))
        data = view(spark, sf_dir, sql)
        out = counterfactual_decompose(formula, data, "g", weights, model, control=control, **{k: v for k, v in more.items() if k != "control"})
        return R.decomposition_table(spark, out).select("effect", "quantile", (F.round("estimate", digits) + 0).alias("estimate"))

    return run


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order priority decomposed by one SQL statement, side by side; equal orders are one row with a count."""
    from countershift import udtf

    udtf.register(spark, "cf_decompose")
    view(spark, sf_dir, SEGMENTS).createOrReplaceTempView("cf_segments")
    out = spark.sql("SELECT * FROM cf_decompose(TABLE(SELECT k, g, y, w, f, count(*) AS n FROM cf_segments GROUP BY k, g, y, w, f) PARTITION BY (k), 'y ~ f', 'g', 'w', 'loc', 'k', 'n')")
    return out.select("k", "effect", F.round("quantile", 6).alias("quantile"), (F.round("estimate", 4) + 0).alias("estimate"))


# ---- quantiles, moments, preparation ---------------------------------------------------------

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def wq_type7(spark, sf_dir):
    return ops.exact_quantiles(view(spark, sf_dir, PRICE), "y", "w", PROBS, "g")


def wq_type2(spark, sf_dir):
    return ops.exact_quantiles(view(spark, sf_dir, PRICE), "y", "w", PROBS, "g", "type2")


def unweighted_percentile(spark, sf_dir):
    rows = view(spark, sf_dir, PRICE).withColumn("one", F.lit(1.0))
    return ops.exact_quantiles(rows, "y", "one", PROBS, "f").select("f", "p", F.round("q", 6).alias("q"))


def histogram(spark, sf_dir):
    return ops.weighted_histogram(view(spark, sf_dir, PRICE), "y", "w", 64, 0.0, 100_000.0, ["g"]).select("g", "bin", "weight", "n")


def prepare_counts(spark, sf_dir):
    rows = view(spark, sf_dir, PRICE).withColumn("y", F.when(F.col("x1") == 0.05, F.lit(None)).when(F.col("x1") == 0.07, F.lit(float("nan"))).otherwise(F.col("y")))
    p = prepare("y ~ x1 + x2 + f", rows, "g", "w", kernel_max_mb=1.0)
    sums = [b.reduce(lambda z: np.array([len(z.y), z.w.sum()])) for b in p.groups]
    out = [(g, int(s[0]), round(float(s[1]), 6), p.omitted_rows, len(p.columns)) for g, s in enumerate(sums)]
    p.release()
    return spark.createDataFrame(out, "g int, n long, w double, omitted long, columns int")


def gram_moments(spark, sf_dir):
    m = moments(view(spark, sf_dir, PRICE), "y", ["x1", "x2"], "w", ["g"])
    return m.select("g", "n", "w", *[F.round(c, 2).alias(c) for c in m.columns if c not in ("g", "n", "w")])


def wls_one_x(spark, sf_dir):
    rows = moments(view(spark, sf_dir, PRICE), "y", ["x1"], None, ["g"]).collect()
    return spark.createDataFrame([(r["g"], *[round(float(v), 4) for v in solve(r, 2)]) for r in rows], "g int, intercept double, slope double")


def wls_saturated(spark, sf_dir):
    from countershift.operators.location import least_squares

    p = prepare("y ~ f", view(spark, sf_dir, PRICE), "g", "w")
    out = [(g, c, round(float(v), 4) + 0.0) for g, b in enumerate(p.groups) for c, v in zip(p.columns, least_squares(b, "qr"))]
    return spark.createDataFrame(out, "g int, term string, coef double")


def group_subsample(spark, sf_dir):
    p = subsample(prepare("y ~ f", view(spark, sf_dir, ORDER), "g", "w"), 1001, 3)
    return spark.createDataFrame([(g, b.rows) for g, b in enumerate(p.groups)], "g int, n int")


def thresholds(spark, sf_dir):
    from countershift.operators.dr import select_thresholds

    p = prepare("y ~ f", view(spark, sf_dir, PRICE), "g", "w", kernel_max_mb=0.01)
    out = [(g, float(t)) for g, b in enumerate(p.groups) for t in select_thresholds(b, 20, Control())]
    p.release()
    return spark.createDataFrame(out, "g int, t double")


def wls_distributed(spark, sf_dir):
    """The same fit from R factors of blocks on executors."""
    from countershift.operators.location import least_squares

    p = prepare("y ~ x1", view(spark, sf_dir, PRICE), "g", kernel_max_mb=0.01)
    out = [(g, *[round(float(v), 4) for v in least_squares(b, "qr")]) for g, b in enumerate(p.groups)]
    p.release()
    return spark.createDataFrame(out, "g int, intercept double, slope double")


def logit_threshold(spark, sf_dir):
    """One binary fit per group, on executors: y at most 30000 on a covariate."""
    from countershift.operators.dr import fit_binary

    p = prepare("y ~ x1", view(spark, sf_dir, PRICE), "g", kernel_max_mb=0.01)
    fits = [fit_binary(b, "logit", np.array([30_000.0]), 50, 1e-13, np.array([1.0, 0.0]))[0][:, 0] for b in p.groups]
    p.release()
    return spark.createDataFrame([(g, *[round(float(v), 6) for v in b]) for g, b in enumerate(fits)], "g int, intercept double, slope double")


def cox_binary(spark, sf_dir):
    from countershift.operators.cox import fit_cox

    p = prepare("y ~ x1", view(spark, sf_dir, DURATION), "g", "w", "cox", event="event")
    return spark.createDataFrame([(g, round(float(fit_cox(b, Control()).coefficients[1, 0]), 6)) for g, b in enumerate(p.groups)], "g int, coef double")


def observed_levels(spark, sf_dir):
    out = counterfactual_decompose("y ~ f", view(spark, sf_dir, ORDER), "g", "w", "loc", control=Control(nreg=5))
    table = R.observed_table(spark, out)
    return table.select("quantile", F.round("reference_observed", 6).alias("reference_observed"), F.round("comparison_observed", 6).alias("comparison_observed"))


def resample_totals(spark, sf_dir):
    """A resample of rows on executors has as many draws as rows, whatever was drawn."""
    from countershift.plans.bootstrap import resample_frame

    p = prepare("y ~ f", view(spark, sf_dir, ORDER), "g", "w", kernel_max_mb=0.01)
    out = [(g, int(resample_frame(b, "counterfactual", 11, g).total)) for g, b in enumerate(p.groups)]
    p.release()
    return spark.createDataFrame(out, "g int, draws long")


def distributed_subsample(spark, sf_dir):
    p = prepare("y ~ f", view(spark, sf_dir, ORDER), "g", "w", kernel_max_mb=0.01)
    part = subsample(p, 777, 5)
    out = [(g, int(b.reduce(lambda z: np.array([len(z.y)]))[0])) for g, b in enumerate(part.groups)]
    p.release()
    return spark.createDataFrame(out, "g int, n int")


def solver_registry(spark, sf_dir):
    from countershift.registry import qr_solver_registry

    return qr_solver_registry(spark).select("solver", "exact", "process_aware")


def simulation(spark, sf_dir):
    from countershift.plans.simulate import simulate_counterfactual_validation

    return spark.createDataFrame(simulate_counterfactual_validation(spark, 3, 200, nreg=19, bootstrap_reps=4).summary)


def tables_of(name: str):
    """Another table of a bootstrapped quantile decomposition."""

    def run(spark, sf_dir):
        out = counterfactual_decompose("y ~ f", view(spark, sf_dir, ORDER), "g", "w", "qr", "pfnb", Control(nreg=10, quantile_noncrossing="rearrange"), bootstrap_reps=6)
        return getattr(R, f"{name}_table")(spark, out)

    return run


def coefficients(spark, sf_dir):
    """Coefficients of a saturated process: differences of the cells' quantiles."""
    table = R.coefficient_table(spark, counterfactual_decompose("y ~ f", view(spark, sf_dir, UNEVEN), "g", "w", "qr", "pfnb", Control(nreg=10)))
    return table.select("group", F.round("grid_value", 6).alias("grid_value"), "term", (F.round("coef", 4) + 0).alias("coef"))


def crossings(spark, sf_dir):
    table = tables_of("crossing")(spark, sf_dir)
    return table.select("distribution", "stage", "correction", "rows", F.col("quantile_pairs").cast("long").alias("quantile_pairs"), "crossing_rows", "crossing_pairs", F.round("max_crossing", 6).alias("max_crossing"))


# ---- curves on fixed inputs ------------------------------------------------------------------

FIXED_CDF = [("a", float(t), v) for t, v in enumerate((-0.2, 0.7, 1.3, 0.6, 0.65, 0.9, 0.85, 1.0), 1)] + [("b", float(t), v) for t, v in enumerate((0.1, 0.05, 0.4, 0.35, 0.3, 0.8), 1)]
FIXED_SQL = ", ".join(f"('{k}', CAST({t} AS DOUBLE), CAST({v} AS DOUBLE))" for k, t, v in FIXED_CDF)
CDF_PROBS = (0.1, 0.32, 0.5, 0.72, 0.99)


def _corrected(method: str):
    def run(spark, sf_dir):
        table = spark.createDataFrame(FIXED_CDF, "k string, t double, cdf double")
        fixed = ops.corrected_cdf(table, method, ["k"])
        return ops.inverted(fixed, CDF_PROBS, ["k"])

    return run


def _corrected_sql(method: str) -> str:
    body = {
        "none": "SELECT k, t, c AS f FROM z",
        "cummax": "SELECT k, t, max(c) OVER (PARTITION BY k ORDER BY t) AS f FROM z",
        "rearrange": "SELECT a.k, a.t, b.c AS f FROM (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM z) a JOIN (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY c) AS i FROM z) b ON a.k = b.k AND a.i = b.i",
        "isotonic": """SELECT k, t, max(m) AS f FROM (SELECT x.k, x.t, a.i AS i, min(am) AS m FROM n x
             JOIN (SELECT a.k, a.i, b.i AS j, (SELECT avg(c) FROM n q WHERE q.k = a.k AND q.i BETWEEN a.i AND b.i) AS am FROM n a JOIN n b ON a.k = b.k AND a.i <= b.i) a
             ON a.k = x.k AND a.i <= x.i AND a.j >= x.i GROUP BY x.k, x.t, a.i) GROUP BY k, t""",
    }[method]
    return f"""WITH z AS (SELECT k, t, least(greatest(v, 0), 1) AS c FROM (VALUES {FIXED_SQL}) s(k, t, v)),
 n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM z), y AS ({body})
 SELECT k, p, coalesce(min(t) FILTER (f >= p), max(t)) AS q FROM y, (VALUES {_values(CDF_PROBS)}) s(p) GROUP BY k, p"""


COEFFICIENTS = np.array([[10.0, 10.4, 10.5, 11.0], [3.0, -4.0, 2.0, -9.0], [1.0, 2.0, -3.0, 0.5]])


def crossing_diagnostics(spark, sf_dir):
    out = ops.crossing(view(spark, sf_dir, PRICE), COEFFICIENTS, ["x1", "x2"], "w", ["g"])
    return out.select("g", "rows", "crossing_rows", F.round("weighted_share", 9).alias("weighted_share"), "crossing_pairs", F.round("max_crossing", 9).alias("max_crossing"), F.round("sum_crossing", 4).alias("sum_crossing"))


# ---- durations -------------------------------------------------------------------------------

KM_PROBS = (0.1, 0.3, 0.5)


def km_quantiles(spark, sf_dir):
    table = kaplan_meier(view(spark, sf_dir, DURATION), "y", "event", "w", ["g"])
    aggregates = [F.min(F.when(F.col("cdf") >= p - 64 * 2.220446049250313e-16, F.col("time"))).alias(f"q{k}") for k, p in enumerate(KM_PROBS)]
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q{k}").alias("q")) for k, p in enumerate(KM_PROBS)])
    return table.groupBy("g").agg(*aggregates).select("g", F.explode(pairs).alias("x")).select("g", "x.p", "x.q")


def km_executors(spark, sf_dir):
    """Kaplan-Meier quantiles of groups whose rows stay on executors."""
    p = prepare("y ~ x1", view(spark, sf_dir, DURATION), "g", "w", "cox", event="event", kernel_max_mb=0.01)
    out = [(g, float(q), float(v)) for g, b in enumerate(p.groups) for q, v in zip(KM_PROBS, km_blocks(b, KM_PROBS, "na"))]
    p.release()
    return spark.createDataFrame(out, "g int, p double, q double")


def exact_price_sums(spark, sf_dir):
    """Sums that no layout changes, rounded once: every return flag's and status' prices."""
    rows = view(spark, sf_dir, PRICE)
    return exact_sums(rows, ["g", "f"], "y", "total").select("g", "f", F.round("total", 2).alias("total"))


def breslow_baseline(spark, sf_dir):
    out = ops.breslow(view(spark, sf_dir, DURATION), "y", "event", "w", 0.3 * F.col("x1"), ["g"])
    return out.groupBy("g").agg(F.count("*").alias("times"), F.round(F.max("hazard"), 8).alias("top"), F.round(F.avg("hazard"), 8).alias("mean"))


def cox_fixed_beta(spark, sf_dir):
    data = view(spark, sf_dir, DURATION)
    baseline = HazardTable(ops.breslow(data.where("g = 0"), "y", "event", "w", 0.3 * F.col("x1"), ["g"]).select("time", "hazard"))
    fit = Fit("cox", np.empty(0), np.array([[0.0], [0.3]]), baseline=baseline)
    p = prepare("y ~ x1", data, "g", "w", "cox", event="event")
    out = [(g, float(q), float(v)) for g, b in enumerate(p.groups) for q, v in zip(KM_PROBS, cox_quantiles(fit, b, KM_PROBS, "na")[0])]
    return spark.createDataFrame(out, "g int, p double, q double")


# ---- bootstrap and simulation ----------------------------------------------------------------

REPS = 40
BOOT_PROBS = (0.25, 0.5, 0.75)


def _draws(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Draws and points of the total effect at three quantiles."""
    data = view(spark, sf_dir, DURATION)
    draws = ops.multiplier_quantile_draws(data, "k", "y", "g", "w", REPS, BOOT_PROBS)
    levels = ops.exact_quantiles(data, "y", "w", BOOT_PROBS, "g", "type2")
    side = lambda g: F.max(F.when(F.col("g") == g, F.col("q")))
    return draws, levels.groupBy(F.col("p").alias("quantile")).agg((side(1) - side(0)).alias("estimate"))


def boot_multiplier_se(spark, sf_dir):
    d = ops.multiplier_draws(view(spark, sf_dir, DURATION), "k", "y", "g", "w", REPS)
    return d.agg(F.count("*").alias("reps"), F.round(F.stddev_samp("effect"), 8).alias("se"), F.round(F.avg("effect"), 8).alias("mean"))


def boot_bands(spark, sf_dir):
    draws, point = _draws(spark, sf_dir)
    out = ops.bands(draws, point, 0.05, normal_quantile(0.975))
    return out.select("quantile", *[F.round(c, 7).alias(c) for c in out.columns[1:-1]], "reps_effective")


def boot_curve_tests(spark, sf_dir):
    draws, point = _draws(spark, sf_dir)
    return ops.curve_tests(draws, point).select(*[F.round(c, 7).alias(c) for c in ("ks", "cms", "ks_p", "cms_p")])


def mixing_rounds_sql(source: str) -> str:
    """Relations h1, h2, h3 over rows (k, rep, ...): a round of mixing each; ``h`` at the end."""
    steps = [f"h0 AS (SELECT *, (k % {ops._PRIME} + (k >> 31) * 69621) % {ops._PRIME} AS h FROM {source})"]
    for i, factor in enumerate(ops._ROUNDS):
        steps.append(f"h{i + 1} AS (SELECT * REPLACE ((xor(h, h >> {15 - i}) * {factor} + rep * {40503 + 2 * i} + 11) % {ops._PRIME} AS h) FROM h{i})")
    return ", ".join(steps)


_BOOT_SQL = f"""d AS (SELECT g, y, w, CAST(k AS BIGINT) AS k FROM ({DURATION})), x AS (SELECT g, y, w, k, unnest(range(1, {REPS + 1})) AS rep FROM d),
 {mixing_rounds_sql("x")},
 e AS (SELECT rep, g, y, w * -ln((h + CAST(0.5 AS DOUBLE)) / CAST({ops._PRIME} AS DOUBLE)) AS w FROM h{len(ops._ROUNDS)}),
 m AS (SELECT rep, g, sum(w * y) / sum(w) AS m FROM e GROUP BY rep, g),
 b AS (SELECT rep, max(m) FILTER (g = 1) - max(m) FILTER (g = 0) AS effect FROM m GROUP BY rep),
 q AS (SELECT p AS quantile FROM (VALUES {_values(BOOT_PROBS)}) t(p)),
 aw AS (SELECT rep, g, y, sum(w) AS w FROM e GROUP BY rep, g, y UNION ALL SELECT 0, g, y, sum(w) FROM d GROUP BY g, y),
 cw AS (SELECT rep, g, y, sum(w) OVER (PARTITION BY rep, g ORDER BY y) AS cw, sum(w) OVER (PARTITION BY rep, g) AS tw FROM aw),
 vq AS (SELECT rep, g, quantile, CASE WHEN bool_or(cw = quantile * tw) THEN (min(y) FILTER (cw >= quantile * tw) + min(y) FILTER (cw > quantile * tw)) / 2 ELSE min(y) FILTER (cw >= quantile * tw) END AS v
  FROM cw, q GROUP BY rep, g, quantile),
 effects AS (SELECT rep, quantile, max(v) FILTER (g = 1) - max(v) FILTER (g = 0) AS estimate FROM vq GROUP BY rep, quantile),
 draws AS (SELECT * FROM effects WHERE rep > 0), point AS (SELECT quantile, estimate FROM effects WHERE rep = 0)"""


def sim_truth(spark, sf_dir):
    probs = (0.1, 0.5, 0.9)
    rows = [(s.name, e, q, round(float(v), 9) + 0.0) for s in SCENARIOS for e, values in s.truth(probs).items() for q, v in zip(probs, values)]
    return spark.createDataFrame(rows, "scenario string, effect string, quantile double, truth double")


def _sim_rows() -> list[tuple]:
    return [("s", r, e, q, 0.1 * r + q, 0.3, 0.1 * r + q - 0.3, 0.05 * r, r % 2 == 0, r % 3 == 0, 0.0) for r in range(1, 7) for e in ("structure", "total") for q in (0.25, 0.75)]


def sim_summary(spark, sf_dir):
    table, _ = summarise(spark.createDataFrame(_sim_rows(), RAW))
    return table.select("scenario", "effect", "quantile", "replications", *[F.round(c, 9).alias(c) for c in ("bias", "monte_carlo_sd", "rmse", "mean_std_error", "pointwise_coverage")])


def sim_curves(spark, sf_dir):
    """How often whole curves are covered."""
    _, curves = summarise(spark.createDataFrame(_sim_rows(), RAW))
    return curves.select("scenario", "effect", "replications", F.round("uniform_coverage", 9).alias("uniform_coverage"))


_Z = {0.1: normal_quantile(0.1), 0.5: 0.0, 0.9: normal_quantile(0.9)}


def _truth_sql() -> str:
    rows = ", ".join(f"('{s.name}', {', '.join(f'CAST({v} AS DOUBLE)' for v in (*s.mu, *s.a, *s.b, s.sigma))}, CAST({q} AS DOUBLE), CAST({z!r} AS DOUBLE))" for s in SCENARIOS for q, z in _Z.items())
    level = lambda m, x: f"(a{m} + b{m} * mu{x} + z * sqrt(b{m} * b{m} + sigma * sigma))"
    effects = {"structure": f"{level(1, 1)} - {level(0, 1)}", "composition": f"{level(0, 1)} - {level(0, 0)}", "total": f"{level(1, 1)} - {level(0, 0)}"}
    return " UNION ALL ".join(f"SELECT scenario, '{e}' AS effect, quantile, round({x}, 9) + 0 AS truth FROM (VALUES {rows}) t(scenario, mu0, mu1, a0, a1, b0, b1, sigma, quantile, z)" for e, x in effects.items())


# ---- decompositions --------------------------------------------------------------------------

LOC_PROBS, DR_PROBS, QR_PROBS = (0.25, 0.5, 0.75), (0.22, 0.52, 0.81), (0.2, 0.5, 0.8)


def _grid_sql(n: int) -> str:
    return _values([(j - 0.5) / n for j in range(1, n + 1)])


def _loc_sql(source: str, nreg: int, scale: bool = False, probs=LOC_PROBS) -> str:
    grid = [(j - 0.5) / nreg for j in range(1, nreg + 1)]
    sigma = "sqrt(exp(sum(w * ln(greatest((y - m) * (y - m), 2.220446049250313e-16))) OVER (PARTITION BY g, f) / sum(w) OVER (PARTITION BY g, f)))" if scale else "CAST(1 AS DOUBLE)"
    return f"""WITH d AS ({source}), a AS (SELECT *, sum(w * y) OVER (PARTITION BY g, f) / sum(w) OVER (PARTITION BY g, f) AS m FROM d),
 s AS (SELECT *, {sigma} AS s FROM a), r AS (SELECT g, (y - m) / s AS v, w, 1 AS n FROM s), {_type7("r", grid, "e")},
 cells AS (SELECT g, f, any_value(m) AS m, any_value(s) AS s, sum(w) AS w, count(*) AS n FROM s GROUP BY g, f),
 draws AS (SELECT k.d AS g, c.m + c.s * e.q AS v, x.w AS w, x.n AS n FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1)) k(d, model, rows)
   JOIN cells x ON x.g = k.rows JOIN cells c ON c.g = k.model AND c.f = x.f JOIN e ON e.g = k.model),
 {_type7("draws", probs, "z")}, levels AS (SELECT g AS d, p, q FROM z) {_effects("levels")}"""


def _dr_sql(source: str, nreg: int) -> str:
    inner = nreg - 2
    places = [1, *(f"least(greatest(CAST(floor(CAST({(k - 0.5) / inner!r} AS DOUBLE) * l) AS BIGINT), 1), l)" for k in range(1, inner + 1)), "l"]
    return f"""WITH d AS ({source}), u AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) AS i, count(*) OVER (PARTITION BY g) AS l FROM (SELECT DISTINCT g, y FROM d)),
 t AS (SELECT g, y AS t FROM u WHERE i IN ({", ".join(map(str, places))})),
 c AS (SELECT t.g, t.t, d.f, sum(CASE WHEN d.y <= t.t THEN d.w ELSE 0 END) / sum(d.w) AS p FROM t JOIN d ON d.g = t.g GROUP BY t.g, t.t, d.f),
 s AS (SELECT g, f, sum(w) / sum(sum(w)) OVER (PARTITION BY g) AS s FROM d GROUP BY g, f),
 m AS (SELECT k.d, c.t, sum(s.s * c.p) AS p FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1)) k(d, model, rows) JOIN s ON s.g = k.rows JOIN c ON c.g = k.model AND c.f = s.f GROUP BY k.d, c.t),
 o AS (SELECT d, t, max(p) OVER (PARTITION BY d ORDER BY t) AS p FROM m),
 levels AS (SELECT d, q.p, coalesce(min(t) FILTER (o.p >= q.p), max(t)) AS q FROM o, (VALUES {_values(DR_PROBS)}) q(p) GROUP BY d, q.p) {_effects("levels")}"""


def _lpm_one_x_sql() -> str:
    places = ["1", *(f"CAST(floor(CAST({(k - 0.5) / 18!r} AS DOUBLE) * l) AS BIGINT)" for k in range(1, 19)), "l"]
    return f"""WITH d AS ({PRICE}), u AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) AS i, count(*) OVER (PARTITION BY g) AS l FROM (SELECT DISTINCT g, y FROM d)),
 t AS (SELECT g, y AS t FROM u WHERE i IN ({", ".join(places)})),
 c AS (SELECT t.g, t.t, regr_slope(CASE WHEN d.y <= t.t THEN 1 ELSE 0 END, x1) AS s, regr_intercept(CASE WHEN d.y <= t.t THEN 1 ELSE 0 END, x1) AS i FROM t JOIN d ON d.g = t.g GROUP BY t.g, t.t),
 x AS (SELECT g, avg(x1) AS x FROM d GROUP BY g),
 m AS (SELECT k.d, c.t, least(greatest(c.i + c.s * x.x, 0), 1) AS p FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1)) k(d, model, rows) JOIN x ON x.g = k.rows JOIN c ON c.g = k.model),
 o AS (SELECT d, t, max(p) OVER (PARTITION BY d ORDER BY t) AS p FROM m),
 levels AS (SELECT d, q.p, coalesce(min(t) FILTER (o.p >= q.p), max(t)) AS q FROM o, (VALUES {_values(DR_PROBS)}) q(p) GROUP BY d, q.p) {_effects("levels")}"""


def _qr_sql(source: str, nreg: int, cell: str = "f") -> str:
    return f"""WITH d AS (SELECT g, y, w, {cell} AS f FROM ({source})), c AS (SELECT *, sum(w) OVER (PARTITION BY g, f ORDER BY y) AS cw, sum(w) OVER (PARTITION BY g, f) AS tw FROM d),
 b AS (SELECT g, f, tau, min(y) FILTER (cw >= tau * tw) AS b FROM c, (VALUES {_grid_sql(nreg)}) t(tau) GROUP BY g, f, tau),
 cells AS (SELECT g, f, sum(w) AS w, count(*) AS n FROM d GROUP BY g, f),
 draws AS (SELECT k.d AS g, b.b AS v, x.w AS w, x.n AS n FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1)) k(d, model, rows) JOIN cells x ON x.g = k.rows JOIN b ON b.g = k.model AND b.f = x.f),
 {_type7("draws", QR_PROBS, "z")}, levels AS (SELECT g AS d, p, q FROM z) {_effects("levels")}"""


def loc_one_x_sql() -> str:
    grid = [(j - 0.5) / 8 for j in range(1, 9)]
    return f"""WITH d AS ({PRICE}), b AS (SELECT g, regr_slope(y, x1) AS s, regr_intercept(y, x1) AS i FROM d GROUP BY g),
 r AS (SELECT d.g, y - i - s * x1 AS v, CAST(1 AS DOUBLE) AS w, 1 AS n FROM d JOIN b ON b.g = d.g), {_type7("r", grid, "e")},
 cells AS (SELECT g, x1, CAST(count(*) AS DOUBLE) AS w, count(*) AS n FROM d GROUP BY g, x1),
 draws AS (SELECT k.d AS g, b.i + b.s * x.x1 + e.q AS v, x.w AS w, x.n AS n FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1)) k(d, model, rows) JOIN cells x ON x.g = k.rows JOIN b ON b.g = k.model JOIN e ON e.g = k.model),
 {_type7("draws", LOC_PROBS, "z")}, levels AS (SELECT g AS d, p, q FROM z) {_effects("levels", 3)}"""


def _table(fn, table, **more):
    def run(spark, sf_dir):
        return table(spark, fn(spark, sf_dir))

    return run


def general(model: str, sql: str, formula: str, **more):
    """A multi-covariate decomposition with its own tables (checked by tests, not SQL)."""

    def run(spark, sf_dir):
        out = counterfactual_decompose(formula, view(spark, sf_dir, sql), "g", "w", model, **more)
        return R.decomposition_table(spark, out)

    return run


def streamed_moments(spark, sf_dir):
    """Moments kept up to date by a streaming query over the events, then solved."""
    from countershift.sources.sinks import shared_folder
    from countershift.streaming.moments import fitted, keep_moments

    folder, remove = shared_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.selectExpr("CAST(user_id % 2 AS INT) AS g", "CAST(value AS DOUBLE) AS y", "CAST(event_id % 3 AS DOUBLE) AS x")
    query = keep_moments(rows, f"{folder}/sums", f"{folder}/checkpoint", "y", ["x"], None, ["g"])
    query.awaitTermination()
    out = [(int(k[0]), *[round(float(v), 8) for v in b]) for k, b in fitted(spark, f"{folder}/sums", ["x"], ["g"]).items()]
    remove()
    return spark.createDataFrame(out, "g int, intercept double, slope double")


DR_MODELS = ("lpm", "logit", "probit", "cloglog")

QUERIES = {
    "wq_type7_by_group": wq_type7, "wq_type2_by_group": wq_type2, "unweighted_percentile": unweighted_percentile, "weighted_histogram": histogram, "prepare_counts": prepare_counts,
    "gram_moments": gram_moments, "wls_one_x": wls_one_x, "wls_saturated": wls_saturated, "group_subsample": group_subsample, "dr_thresholds": thresholds, "wls_distributed": wls_distributed, "logit_one_x_threshold": logit_threshold, "cox_one_binary_x": cox_binary,
    "observed_levels": observed_levels, "resample_totals": resample_totals, "distributed_subsample": distributed_subsample, "solver_registry": solver_registry, "simulation_validation": simulation,
    **{f"qr_{n}_table": tables_of(n) for n in ("marginalization", "tests", "draws")}, "qr_coefficient_table": coefficients, "qr_crossing_table": crossings,
    **{f"cdf_{m}": _corrected(m) for m in ("none", "cummax", "rearrange", "isotonic")}, "crossing_diagnostics": crossing_diagnostics,
    "km_quantiles": km_quantiles, "breslow_baseline": breslow_baseline, "cox_fixed_beta": cox_fixed_beta,
    "boot_multiplier_se": boot_multiplier_se, "boot_bands": boot_bands, "boot_curve_tests": boot_curve_tests, "sim_truth": sim_truth, "sim_summary": sim_summary, "sim_curves": sim_curves, "streamed_moments": streamed_moments,
    "loc_saturated_decomp": _decomposed("y ~ f", PRICE, "loc", LOC_PROBS, 8), "loc_joined_decomp": _decomposed("y ~ f", JOINED, "loc", LOC_PROBS, 8), "loc_one_x_decomp": _decomposed("y ~ x1", PRICE, "loc", LOC_PROBS, 8, None, 3),
    "locsca_saturated_decomp": _decomposed("y ~ f", PRICE, "locsca", LOC_PROBS, 8), "lpm_one_x_decomp": _decomposed("y ~ x1", PRICE, "lpm", DR_PROBS, 20, None),
    **{f"{m}_saturated_decomp": _decomposed("y ~ f", ORDER, m, DR_PROBS, 20) for m in DR_MODELS},
    "qr_saturated_decomp": _decomposed("y ~ f", PRICE, "qr", QR_PROBS, 16), "qr_intercept_only": _decomposed("y ~ 1", ORDER, "qr", QR_PROBS, 16),
    "qr_distributed_decomp": _decomposed("y ~ f", PRICE, "qr", QR_PROBS, 8, control={"kernel_max_mb": 0.5}),
    # the same on executors, whatever the size
    **{f"{m}_executors_decomp": _decomposed("y ~ f", PRICE if m.startswith("loc") else ORDER, m, LOC_PROBS if m.startswith("loc") else DR_PROBS, 8 if m.startswith("loc") else 20, control={"kernel_max_mb": 0.01}) for m in ("loc", "locsca", "lpm", "logit")},
    "splines_saturated_decomp": _decomposed("y ~ bs(x1, knots = c(0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09), degree = 1)", PRICE, "loc", LOC_PROBS, 8),
    "equal_cuts_decomp": _decomposed("y ~ cut(x1, 4)", PRICE, "loc", LOC_PROBS, 8),
    "segments_by_sql": _segments, "km_executors": km_executors, "exact_sums": exact_price_sums,
    "pfnb_general": general("qr", PRICE, "y ~ x1 + x2 + f", solver="pfnb", control=Control(nreg=20)), "onestep_general": general("qr", PRICE, "y ~ x1 + f", solver="onestep", control=Control(nreg=25)),
    "cqr_general": general("cqr", CENSORED, "y ~ f", censoring="cens", control=Control(cqr_boundary="na")), "cox_general": general("cox", DURATION, "y ~ x1", event="event", control=Control(reported_quantiles=(0.1, 0.3, 0.5))),
    "boot_counterfactual": general("loc", ORDER, "y ~ f", control=Control(nreg=20), bootstrap_reps=8), "boot_qr_xy": general("qr", ORDER, "y ~ f", solver="pfnb", control=Control(nreg=5, qr_bootstrap_engine="xy_preprocess"), bootstrap_reps=8),
}

_XX = [f"round(sum(w * {a} * {b}), 2) AS xx_{i}_{j}" for i, a in enumerate(("1", "x1", "x2")) for j, b in enumerate(("1", "x1", "x2")[: i + 1])]
_XY = [f"round(sum(w * {a} * y), 2) AS xy_{i}" for i, a in enumerate(("1", "x1", "x2"))]

ORACLE_SQL = {
    "wq_type7_by_group": f"WITH d AS (SELECT g, y AS v, w, 1 AS n FROM ({PRICE})), {_type7('d', PROBS, 'z')} SELECT g, p, q FROM z",
    "wq_type2_by_group": f"""WITH a AS (SELECT g, y, sum(w) AS w FROM ({PRICE}) GROUP BY g, y), c AS (SELECT g, y, sum(w) OVER (PARTITION BY g ORDER BY y) AS cw, sum(w) OVER (PARTITION BY g) AS tw, lead(y) OVER (PARTITION BY g ORDER BY y) AS nx FROM a)
      SELECT g, p, CASE WHEN min(cw) FILTER (cw >= p * tw) = max(p * tw) THEN (min(y) FILTER (cw >= p * tw) + min(nx) FILTER (cw >= p * tw)) / 2 ELSE min(y) FILTER (cw >= p * tw) END AS q
      FROM c, (VALUES {_values(PROBS)}) t(p) GROUP BY g, p""",
    "unweighted_percentile": f"SELECT f, p, round(q, 6) AS q FROM (SELECT f, unnest([{', '.join(map(str, PROBS))}])::DOUBLE AS p, unnest(quantile_cont(y, [{', '.join(map(str, PROBS))}])) AS q FROM ({PRICE}) GROUP BY f)",
    "weighted_histogram": f"SELECT g, CAST(least(greatest(floor(y / CAST(100000 AS DOUBLE) * 64), 0), 63) AS BIGINT) AS bin, sum(w) AS weight, count(*) AS n FROM ({PRICE}) GROUP BY g, bin",
    "prepare_counts": f"WITH d AS (SELECT * FROM ({PRICE}) WHERE x1 NOT IN (CAST(0.05 AS DOUBLE), CAST(0.07 AS DOUBLE))) SELECT g, count(*) AS n, round(sum(w) / (SELECT avg(w) FROM d), 6) AS w, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM d) AS omitted, 5 AS columns FROM d GROUP BY g",
    "gram_moments": f"SELECT g, count(*) AS n, sum(w) AS w, round(sum(w * y * y), 2) AS yy, {', '.join(_XX + _XY)} FROM ({PRICE}) GROUP BY g",
    "wls_one_x": f"SELECT g, round(regr_intercept(y, x1), 4) AS intercept, round(regr_slope(y, x1), 4) AS slope FROM ({PRICE}) GROUP BY g",
    "wls_saturated": f"""WITH c AS (SELECT g, f, sum(w * y) / sum(w) AS m FROM ({PRICE}) GROUP BY g, f), b AS (SELECT g, arg_min(m, f) AS m, min(f) AS f FROM c GROUP BY g)
      SELECT c.g, CASE WHEN c.f = b.f THEN '(Intercept)' ELSE 'f' || c.f END AS term, round(CASE WHEN c.f = b.f THEN c.m ELSE c.m - b.m END, 4) + 0 AS coef FROM c JOIN b ON b.g = c.g""",
    "wls_distributed": f"SELECT g, round(regr_intercept(y, x1), 4) AS intercept, round(regr_slope(y, x1), 4) AS slope FROM ({PRICE}) GROUP BY g",
    "logit_one_x_threshold": f"""WITH RECURSIVE a AS (SELECT g, x1 AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (y <= 30000) AS DOUBLE) AS k FROM ({PRICE}) GROUP BY g, x1),
      t AS (SELECT DISTINCT g, 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM a UNION ALL
        SELECT g, i + 1, b0 + (h11 * s0 - h01 * s1) / (h00 * h11 - h01 * h01), b1 + (h00 * s1 - h01 * s0) / (h00 * h11 - h01 * h01) FROM (
          SELECT g, i, b0, b1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) AS h11, sum(k - n * m) AS s0, sum((k - n * m) * x) AS s1 FROM (
            SELECT t.g, i, b0, b1, x, n, k, 1 / (1 + exp(-b0 - b1 * x)) AS m FROM t JOIN a ON a.g = t.g WHERE i < 12) GROUP BY g, i, b0, b1))
      SELECT g, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM t WHERE i = 12""",
    "cox_one_binary_x": f"""WITH RECURSIVE e AS (SELECT g, y, sum(w * event) AS d, sum(w * event * x1) AS d1, sum(w * (1 - x1)) AS a, sum(w * x1) AS b FROM ({DURATION}) GROUP BY g, y),
      r AS (SELECT g, d, d1, sum(a) OVER (PARTITION BY g ORDER BY y DESC) AS a, sum(b) OVER (PARTITION BY g ORDER BY y DESC) AS b FROM e),
      t AS (SELECT DISTINCT g, 0 AS i, CAST(0 AS DOUBLE) AS c FROM r UNION ALL
        SELECT g, i + 1, c + s / h FROM (SELECT g, i, c, sum(d1 - d * p) AS s, sum(d * p * (1 - p)) AS h FROM (
          SELECT t.g, i, c, d, d1, b * exp(c) / (a + b * exp(c)) AS p FROM t JOIN r ON r.g = t.g WHERE i < 12) GROUP BY g, i, c))
      SELECT g, round(c, 6) AS coef FROM t WHERE i = 12""",
    "observed_levels": f"""WITH d AS (SELECT g, y AS v, w, 1 AS n FROM ({ORDER})), {_type7('d', [k / 10 for k in range(1, 10)], 'z')}
      SELECT p AS quantile, round(max(q) FILTER (g = 0), 6) AS reference_observed, round(max(q) FILTER (g = 1), 6) AS comparison_observed FROM z GROUP BY p""",
    "resample_totals": f"SELECT g, count(*) AS draws FROM ({ORDER}) GROUP BY g",
    "distributed_subsample": f"WITH c AS (SELECT count(*) FILTER (g = 1) AS a, count(*) AS n FROM ({ORDER})) SELECT g, CAST(CASE WHEN g = 1 THEN round_even(777 * a / n, 0) ELSE 777 - round_even(777 * a / n, 0) END AS INTEGER) AS n FROM c, (VALUES (0), (1)) t(g)",
    "solver_registry": "SELECT * FROM (VALUES ('br', true, false), ('fn', true, false), ('pfn', true, false), ('qfnb', true, true), ('pfnb', true, true), ('proqreg', true, true), ('profn', true, true), ('onestep', false, true), ('cuda_admm', false, true)) t(solver, exact, process_aware)",
    "lpm_one_x_decomp": _lpm_one_x_sql(),
    "group_subsample": f"WITH c AS (SELECT count(*) FILTER (g = 1) AS a, count(*) AS n FROM ({ORDER})) SELECT g, CAST(CASE WHEN g = 1 THEN round_even(1001 * a / n, 0) ELSE 1001 - round_even(1001 * a / n, 0) END AS INTEGER) AS n FROM c, (VALUES (0), (1)) t(g)",
    "dr_thresholds": f"""WITH u AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) AS i, count(*) OVER (PARTITION BY g) AS l FROM (SELECT DISTINCT g, y FROM ({PRICE})))
      SELECT g, y AS t FROM u WHERE i IN (1, l, {', '.join(f'CAST(floor(CAST({(k - 0.5) / 18!r} AS DOUBLE) * l) AS BIGINT)' for k in range(1, 19))})""",
    **{f"cdf_{m}": _corrected_sql(m) for m in ("none", "cummax", "rearrange", "isotonic")},
    "crossing_diagnostics": f"""WITH d AS (SELECT g, w, [{', '.join('(' + ' + '.join(f'CAST({COEFFICIENTS[i, k] - COEFFICIENTS[i, k + 1]!r} AS DOUBLE)' + f' * {x}' for i, x in enumerate(('1', 'x1', 'x2'))) + ')' for k in range(3))}] AS f FROM ({PRICE})),
      e AS (SELECT g, w, list_filter(f, lambda x: x > 1e-8) AS f FROM d)
      SELECT g, count(*) AS rows, count(*) FILTER (len(f) > 0) AS crossing_rows, round(sum(w) FILTER (len(f) > 0) / sum(w), 9) AS weighted_share, CAST(sum(len(f)) AS BIGINT) AS crossing_pairs, round(max(list_max(f)), 9) AS max_crossing, round(sum(list_sum(f)), 4) AS sum_crossing FROM e GROUP BY g""".replace("np.float64", ""),
    "km_quantiles": f"""WITH d AS ({DURATION}), t AS (SELECT g, y, sum(w * event) AS d, sum(w) AS w FROM d GROUP BY g, y), r AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY y DESC) AS r FROM t),
      s AS (SELECT g, y, 1 - CASE WHEN max(CASE WHEN 1 - d / r <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY y) = 1 THEN 0 ELSE exp(sum(CASE WHEN 1 - d / r > 0 THEN ln(1 - d / r) ELSE 0 END) OVER (PARTITION BY g ORDER BY y)) END AS cdf FROM r)
      SELECT g, p, min(y) FILTER (cdf >= p - {EPS64}) AS q FROM s, (VALUES {_values(KM_PROBS)}) v(p) GROUP BY g, p""",
    "breslow_baseline": f"""WITH t AS (SELECT g, y, sum(w * event) AS d, sum(w * exp(CAST(0.3 AS DOUBLE) * x1)) AS s FROM ({DURATION}) GROUP BY g, y), r AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY y DESC) AS r FROM t),
      h AS (SELECT g, d, sum(d / r) OVER (PARTITION BY g ORDER BY y) AS h FROM r) SELECT g, count(*) AS times, round(max(h), 8) AS top, round(avg(h), 8) AS mean FROM h WHERE d > 0 GROUP BY g""",
    "cox_fixed_beta": f"""WITH d AS ({DURATION}), t AS (SELECT y, sum(w * event) AS d, sum(w * exp(CAST(0.3 AS DOUBLE) * x1)) AS s FROM d WHERE g = 0 GROUP BY y), r AS (SELECT *, sum(s) OVER (ORDER BY y DESC) AS r FROM t),
      h AS (SELECT * FROM (SELECT y, d, sum(d / r) OVER (ORDER BY y) AS h FROM r) WHERE d > 0), c AS (SELECT g, x1, sum(w) AS w FROM d GROUP BY g, x1),
      f AS (SELECT g, y, sum(w * (1 - exp(-h * exp(CAST(0.3 AS DOUBLE) * x1)))) / sum(w) AS f FROM h, c GROUP BY g, y)
      SELECT g, p, min(y) FILTER (f >= p - {EPS64}) AS q FROM f, (VALUES {_values(KM_PROBS)}) v(p) GROUP BY g, p""",
    "boot_multiplier_se": f"WITH {_BOOT_SQL} SELECT count(*) AS reps, round(stddev_samp(effect), 8) AS se, round(avg(effect), 8) AS mean FROM b",
    "boot_bands": f"""WITH {_BOOT_SQL}, s AS (SELECT quantile, stddev_samp(estimate) AS se, count(estimate) AS n FROM draws GROUP BY quantile), j AS (SELECT p.quantile, p.estimate, se, n FROM point p JOIN s ON s.quantile = p.quantile),
      t AS (SELECT rep, max(abs(draws.estimate - j.estimate) / se) AS t FROM draws JOIN j ON j.quantile = draws.quantile GROUP BY rep), c AS (SELECT quantile_cont(t, 0.95) AS c FROM t)
      SELECT quantile, round(estimate, 7) AS estimate, round(se, 7) AS std_error, round(estimate - {normal_quantile(0.975)!r} * se, 7) AS pointwise_lower, round(estimate + {normal_quantile(0.975)!r} * se, 7) AS pointwise_upper,
       round(estimate - c * se, 7) AS uniform_lower, round(estimate + c * se, 7) AS uniform_upper, n AS reps_effective FROM j, c""",
    "boot_curve_tests": f"""WITH {_BOOT_SQL}, z AS (SELECT rep, draws.quantile, draws.estimate - point.estimate AS c FROM draws JOIN point ON point.quantile = draws.quantile), v AS (SELECT quantile, var_samp(c) AS v FROM z GROUP BY quantile),
      o AS (SELECT sqrt(max(estimate * estimate / v)) AS ks, avg(estimate * estimate / v) AS cms FROM point JOIN v ON v.quantile = point.quantile), ee AS (SELECT rep, sqrt(max(c * c / v)) AS k, avg(c * c / v) AS c FROM z JOIN v ON v.quantile = z.quantile GROUP BY rep)
      SELECT round(ks, 7) AS ks, round(cms, 7) AS cms, round(avg(CASE WHEN k > ks THEN 1.0 ELSE 0.0 END), 7) AS ks_p, round(avg(CASE WHEN c > cms THEN 1.0 ELSE 0.0 END), 7) AS cms_p FROM ee, o GROUP BY ks, cms""",
    "qr_coefficient_table": f"""WITH d AS ({UNEVEN}), c AS (SELECT *, sum(w) OVER (PARTITION BY g, f ORDER BY y) AS cw, sum(w) OVER (PARTITION BY g, f) AS tw FROM d),
      b AS (SELECT g, f, tau, min(y) FILTER (cw >= tau * tw) AS b FROM c, (VALUES {_grid_sql(10)}) t(tau) GROUP BY g, f, tau), l AS (SELECT min(f) AS f FROM d)
      SELECT b.g AS "group", round(b.tau, 6) AS grid_value, CASE WHEN b.f = l.f THEN '(Intercept)' ELSE 'f' || b.f END AS term, round(b.b - CASE WHEN b.f = l.f THEN 0 ELSE a.b END, 4) + 0 AS coef
      FROM b, l JOIN b a ON a.f = l.f WHERE a.g = b.g AND a.tau = b.tau""",
    "qr_crossing_table": f"""WITH d AS ({ORDER}), c AS (SELECT *, sum(w) OVER (PARTITION BY g, f ORDER BY y) AS cw, sum(w) OVER (PARTITION BY g, f) AS tw FROM d),
      b AS (SELECT g, f, tau, min(y) FILTER (cw >= tau * tw) AS b FROM c, (VALUES {_grid_sql(10)}) t(tau) GROUP BY g, f, tau),
      k AS (SELECT g, f, tau, b, lag(b) OVER (PARTITION BY g, f ORDER BY tau) - b AS fall FROM b),
      x AS (SELECT g, f, count(*) FILTER (fall > 1e-8) AS pairs, coalesce(max(fall) FILTER (fall > 1e-8), CAST(0 AS DOUBLE)) AS most FROM k GROUP BY g, f),
      n AS (SELECT g, f, count(*) AS n FROM d GROUP BY g, f)
      SELECT distribution, stage, CASE WHEN stage = 'raw' THEN 'none' ELSE 'rearrange' END AS correction, CAST(sum(n.n) AS BIGINT) AS rows, CAST(9 * sum(n.n) AS BIGINT) AS quantile_pairs,
       CAST(coalesce(sum(n.n) FILTER (stage = 'raw' AND pairs > 0), 0) AS BIGINT) AS crossing_rows, CAST(coalesce(sum(n.n * pairs) FILTER (stage = 'raw'), 0) AS BIGINT) AS crossing_pairs,
       round(coalesce(max(most) FILTER (stage = 'raw'), 0), 6) AS max_crossing
      FROM (VALUES ('reference_model_X0', 0, 0), ('reference_model_X1_counterfactual', 0, 1), ('comparison_model_X1', 1, 1)) v(distribution, model, rows), (VALUES ('raw'), ('corrected')) s(stage)
       JOIN n ON true JOIN x ON x.f = n.f WHERE n.g = v.rows AND x.g = v.model GROUP BY distribution, stage""",
    "sim_truth": _truth_sql(),
    "sim_summary": f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}', {r[1]}, '{r[2]}', CAST({r[3]} AS DOUBLE), CAST({r[4]!r} AS DOUBLE), CAST({r[6]!r} AS DOUBLE), CAST({r[7]!r} AS DOUBLE), {r[8]})" for r in _sim_rows())}) t(scenario, r, effect, quantile, estimate, error, se, covered))
      SELECT scenario, effect, quantile, count(*) AS replications, round(avg(error), 9) AS bias, round(stddev_samp(estimate), 9) AS monte_carlo_sd, round(sqrt(avg(error * error)), 9) AS rmse, round(avg(se), 9) AS mean_std_error,
       round(avg(CASE WHEN covered THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS pointwise_coverage FROM t GROUP BY scenario, effect, quantile""",
    "sim_curves": f"""WITH t AS (SELECT DISTINCT * FROM (VALUES {', '.join(f"('{r[0]}', {r[1]}, '{r[2]}', {r[9]})" for r in _sim_rows())}) t(scenario, r, effect, covered))
      SELECT scenario, effect, count(*) AS replications, round(avg(CASE WHEN covered THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS uniform_coverage FROM t GROUP BY scenario, effect""",
    "streamed_moments": "SELECT CAST(user_id % 2 AS INTEGER) AS g, round(regr_intercept(value, event_id % 3), 8) AS intercept, round(regr_slope(value, event_id % 3), 8) AS slope FROM events GROUP BY user_id % 2",
    **{f"{m}_executors_decomp": sql for m, sql in (("loc", _loc_sql(PRICE, 8)), ("locsca", _loc_sql(PRICE, 8, True)), ("lpm", _dr_sql(ORDER, 20)), ("logit", _dr_sql(ORDER, 20)))},
    "splines_saturated_decomp": _loc_sql(LEVELS, 8),
    "equal_cuts_decomp": _loc_sql(PRICE.replace("l_returnflag AS f", "CASE WHEN l_discount <= 0.025 THEN 1 WHEN l_discount <= 0.05 THEN 2 WHEN l_discount <= 0.075 THEN 3 ELSE 4 END AS f"), 8),
    "segments_by_sql": " UNION ALL ".join(f"SELECT '{k}' AS k, effect, round(quantile, 6) AS quantile, estimate FROM ({_loc_sql(f"SELECT g, y, w, f FROM ({SEGMENTS.replace('STRING', 'VARCHAR')}) WHERE k = '{k}'", 100, probs=NINE)})" for k in PRIORITIES),
    "exact_sums": f"SELECT g, f, round(CAST(sum(CAST(y AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total FROM ({PRICE}) GROUP BY g, f",
    "loc_saturated_decomp": _loc_sql(PRICE, 8), "loc_joined_decomp": _loc_sql(JOINED, 8), "loc_one_x_decomp": loc_one_x_sql(), "locsca_saturated_decomp": _loc_sql(PRICE, 8, True),
    **{f"{m}_saturated_decomp": _dr_sql(ORDER, 20) for m in DR_MODELS},
    "qr_saturated_decomp": _qr_sql(PRICE, 16), "qr_intercept_only": _qr_sql(ORDER, 16, "1"), "qr_distributed_decomp": _qr_sql(PRICE, 8),
}
ORACLE_SQL["km_executors"] = ORACLE_SQL["km_quantiles"]

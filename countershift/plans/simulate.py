"""Monte Carlo validation against closed-form effects: one task per scenario and replication."""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countershift import checks
from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.operators.blocks import LocalBlocks
from countershift.plans.bootstrap import _attempts, replicate, resolve_engine
from countershift.plans.decompose import estimate_point
from countershift.plans.inference import effect_bands
from countershift.result import _csv
from countershift.schemas import EFFECTS
from countershift.sources.files import files_of, joined, write_atomic
from countershift.sources.sinks import write_together
from countershift.sources.synthetic import SCENARIOS, draw, scenario

RAW = "scenario string, replication int, effect string, quantile double, estimate double, truth double, error double, std_error double, pointwise_covered boolean, curve_covered boolean, identity_residual double"


@dataclass
class Simulation:
    raw: pd.DataFrame
    summary: pd.DataFrame
    curve_coverage: pd.DataFrame
    resources: pd.DataFrame
    failures: pd.DataFrame
    settings: dict


def task_seed(seed: int, scenario_number: int, replication: int, attempt: int = 0) -> int:
    """The same data for a scenario and replication, whatever else is asked for."""
    return 1 + (seed + 7919 * replication + 104_729 * scenario_number + 1_000_003 * attempt - 1) % (2**31 - 2)


def one_task(name: str, number: int, replication: int, attempt: int, n: int, solver: str, control: Control, weighted: bool, reps: int, seed: int) -> list[dict]:
    s = scenario(name)
    own = task_seed(seed, number, replication, attempt)
    data = draw(s, n, own, weighted)
    w = data["weight"].to_numpy() / data["weight"].mean()
    groups = tuple(LocalBlocks(np.column_stack([np.ones(n), d["x"]]), d["y"], w[d.index]) for _, d in data.groupby("group"))
    point = estimate_point(groups, "qr", solver, control, with_observed=False)
    truth, bands = s.truth(control.reported_quantiles), {}
    if reps:
        engine = resolve_engine("qr", solver, control)
        draws = [replicate(groups, point, "qr", solver, control, engine, own, r, 0) for r in range(1, reps + 1)]
        bands = {e: effect_bands(point.effects[e], np.array([d[e] for d in draws]), control.alpha, control.robust_se) for e in EFFECTS}
    rows = []
    for e in EFFECTS:
        b = bands.get(e)
        inside = None if b is None else (b["uniform_lower"] <= truth[e]) & (truth[e] <= b["uniform_upper"])
        for k, q in enumerate(control.reported_quantiles):
            rows.append({
                "scenario": name, "replication": replication, "effect": e, "quantile": q, "estimate": float(point.effects[e][k]), "truth": float(truth[e][k]), "error": float(point.effects[e][k] - truth[e][k]),
                "std_error": None if b is None else float(b["std_error"][k]), "pointwise_covered": None if b is None else bool(b["pointwise_lower"][k] <= truth[e][k] <= b["pointwise_upper"][k]),
                "curve_covered": None if inside is None else bool(inside.all()), "identity_residual": point.residual,
            })
    return rows


def summarise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bias, spread and coverage by scenario, effect and quantile; and coverage of whole curves."""
    keys = ["scenario", "effect", "quantile"]
    table = raw.groupBy(*keys).agg(
        F.count("*").alias("replications"), F.avg("estimate").alias("mean_estimate"), F.first("truth").alias("truth"), F.avg("error").alias("bias"),
        F.stddev_samp("estimate").alias("monte_carlo_sd"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("std_error").alias("mean_std_error"),
        F.avg(F.col("pointwise_covered").cast("double")).alias("pointwise_coverage"), F.max("identity_residual").alias("max_identity_residual"),
    )
    curves = raw.select("scenario", "replication", "effect", "curve_covered").distinct().groupBy("scenario", "effect").agg(F.count("*").alias("replications"), F.avg(F.col("curve_covered").cast("double")).alias("uniform_coverage"))
    return table.orderBy(*keys), curves.orderBy("scenario", "effect")


def simulate_counterfactual_validation(
    spark: SparkSession, replications: int = 100, n_per_group: int = 1000, scenarios=None, solver: str = "auto", nreg: int = 49, trimming: float = 0.005, reported_quantiles=(0.1, 0.5, 0.9),
    weighted: bool = True, bootstrap_reps: int = 0, bootstrap_scheme: str = "counterfactual", workers: int = 1, seed: int = 1, progress: bool = False, checkpoint_dir: str | None = None,
    max_retries: int = 2, task_timeout_seconds: float | None = None,
) -> Simulation:
    """A grid of tasks on executors; finished tasks are checkpointed and never run twice."""
    checks.integer("replications", replications, 1)
    checks.integer("n_per_group", n_per_group, 10)
    names = [s.name for s in SCENARIOS] if scenarios is None else list(scenarios)
    numbers = {s.name: k for k, s in enumerate(SCENARIOS)}
    for n in names:
        scenario(n)
    control = Control(nreg=nreg, trimming=trimming, reported_quantiles=tuple(reported_quantiles), bootstrap_scheme=bootstrap_scheme)
    settings = {"n_per_group": n_per_group, "solver": solver, "nreg": nreg, "trimming": trimming, "reported_quantiles": control.reported_quantiles, "weighted": weighted, "bootstrap_reps": bootstrap_reps, "bootstrap_scheme": bootstrap_scheme, "seed": seed, "version": 1}
    mark = hashlib.sha256(json.dumps(settings, sort_keys=True, default=list).encode()).hexdigest()[:24]
    path = lambda n, r: joined(checkpoint_dir, f"simulation_{mark}_{n}_{r:06d}.json")
    done: dict[tuple[str, int], dict] = {}
    tasks = [(n, r) for n in names for r in range(1, replications + 1)]
    if checkpoint_dir:
        files_of(checkpoint_dir).make_folder(checkpoint_dir)
        for n, r in tasks:
            found = _read(path(n, r), mark, 3 * len(control.reported_quantiles))
            if found:
                done[n, r] = found
    missing = [t for t in tasks if t not in done]

    def work(frames):
        for frame in frames:
            out = []
            for n, r in zip(frame["scenario"], frame["replication"]):
                limit = time.perf_counter() + (task_timeout_seconds or float("inf"))

                def attempt(a, n=n, r=r, limit=limit):
                    if time.perf_counter() > limit:
                        raise DecompositionError("the task's time is over")
                    attempt.rows = one_task(n, numbers[n], int(r), a, n_per_group, solver, control, weighted, bootstrap_reps, seed)
                    return {e: np.zeros(1) for e in EFFECTS}

                result = _attempts(attempt, int(r), max_retries)
                rows = attempt.rows if result["effects"] is not None else None
                out.append(json.dumps({"mark": mark, "scenario": n, "replication": int(r), "rows": rows, "failures": result["failures"], "elapsed_sec": result["elapsed_sec"], "attempts": result["attempts"]}))
            yield pd.DataFrame({"result": out})

    if missing:
        ids = spark.createDataFrame(missing, "scenario string, replication int").repartition(min(len(missing), 4 * spark.sparkContext.defaultParallelism))
        for row in ids.mapInPandas(work, "result string").toLocalIterator():
            found = json.loads(row["result"])
            done[found["scenario"], found["replication"]] = found
            if checkpoint_dir and found["rows"] is not None:
                write_atomic(path(found["scenario"], found["replication"]), row["result"])
    order = [done[t] for t in tasks]
    names_of = [p.split()[0] for p in RAW.split(", ")]
    raw_rows = [tuple(x[c] for c in names_of) for d in order if d["rows"] for x in d["rows"]]
    if not raw_rows:
        raise DecompositionError("every simulation task failed")
    raw = spark.createDataFrame(raw_rows, RAW)
    table, curves = summarise(raw)
    resources = pd.DataFrame([{k: d[k] for k in ("scenario", "replication", "elapsed_sec", "attempts")} for d in order])
    failures = pd.DataFrame([{"scenario": d["scenario"], **f} for d in order for f in d["failures"]])
    return Simulation(pd.DataFrame(raw_rows, columns=names_of), table.toPandas(), curves.toPandas(), resources, failures, settings)


def _read(path: str, mark: str, rows: int) -> dict | None:
    try:
        d = json.loads(files_of(path).read(path))
        ok = d["mark"] == mark and len(d["rows"]) == rows and all(np.isfinite(x["estimate"]) and np.isfinite(x["truth"]) for x in d["rows"])
        return d if ok and d["elapsed_sec"] >= 0 else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def write_simulation_validation(result: Simulation, output_dir: str) -> list[str]:
    # The output files.
    files = {"simulation_summary.csv": result.summary, "simulation_raw.csv": result.raw, "simulation_resources.csv": result.resources, "simulation_curve_coverage.csv": result.curve_coverage}
    optional = {"simulation_failures.csv": result.failures}

    def write(stage: str) -> None:
        for name, table in (files | {k: v for k, v in optional.items() if len(v)}).items():
            _csv(os.path.join(stage, name), table.to_dict("records"), list(table.columns))

    return write_together(output_dir, [*files, *optional], write, files)

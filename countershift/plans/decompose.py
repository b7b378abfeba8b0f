"""The decomposition: two fitted groups, three marginal distributions, three effects."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from countershift.checks import choice, integer
from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.operators.blocks import Blocks
from countershift.operators.cox import fit_cox, km_blocks
from countershift.operators.cqr import fit_censored
from countershift.operators.dr import fit_distribution
from countershift.operators.location import fit_location, fit_location_scale
from countershift.operators.marginal import crossing_row, marginal_quantiles
from countershift.operators.models import DISTRIBUTION_MODELS, MODELS, PROCESS_MODELS, Fit
from countershift.operators.qr import fit_process, resolve_solver
from countershift.operators.selection import quantiles
from countershift.plans.inference import effect_bands, functional_tests
from countershift.registry import backends, solvers
from countershift.schemas import DISTRIBUTIONS, EFFECTS, SCHEMA_VERSION
from countershift.sources.prepare import Prepared, prepare

IDENTITY = 1e-10
#: Rows of the smaller group from which both are fitted at the same time.
SIDE_BY_SIDE_FROM = 20_000


@dataclass
class Point:
    fits: tuple[Fit, Fit]
    effects: dict[str, np.ndarray]
    levels: dict[str, np.ndarray]
    marginalization: list[dict]
    resources: list[dict]
    residual: float


@dataclass
class Decomposition:
    """The result object; see :mod:`countershift.result` for its tables, summary, plot and files."""

    model: str
    solver: str | None
    control: Control
    quantiles: np.ndarray
    point: Point
    crossing: list[dict]
    metadata: dict
    bands: dict[str, dict] | None = None
    draws: dict[str, np.ndarray] | None = None
    tests: list[dict] = field(default_factory=list)
    bootstrap_resources: list[dict] = field(default_factory=list)
    bootstrap_failures: list[dict] = field(default_factory=list)

    @property
    def reps(self) -> int:
        return 0 if self.draws is None else len(next(iter(self.draws.values())))

    def rows(self) -> list[dict]:
        """The decomposition table's rows: effects in order, quantiles ascending."""
        out = []
        for effect in EFFECTS:
            own = self.point.effects[effect]
            bands = self.bands[effect] if self.bands else {}
            for k, q in enumerate(self.quantiles):
                value = lambda name, k=k, bands=bands: None if name not in bands or np.isnan(bands[name][k]) else float(bands[name][k])
                identified = bool(np.isfinite(own[k]))
                out.append({
                    "model": self.model, "solver": self.solver, "quantile": float(q), "effect": effect, "estimate": float(own[k]) if identified else None, "identified": identified,
                    **{c: value(c) for c in ("std_error", "pointwise_lower", "pointwise_upper", "uniform_lower", "uniform_upper")},
                    "bootstrap_reps": self.reps, "bootstrap_reps_effective": int(bands["bootstrap_reps_effective"][k]) if bands else 0, "alpha": self.control.alpha,
                })
        return out


def validate(model: str, solver: str | None, control: Control) -> str | None:
    choice("model", model, MODELS)
    if model in PROCESS_MODELS:
        return solver or "auto"
    if solver not in (None, "auto"):
        raise DecompositionError("a solver is only used by the qr and cqr models")
    return None


def fit_group(blocks: Blocks, model: str, solver: str | None, control: Control) -> Fit:
    grid = control.for_model(model)
    if model == "qr":
        return fit_process(blocks, grid, solver, control)
    if model == "cqr":
        return fit_censored(blocks, grid, solver, control)
    if model == "loc":
        return fit_location(blocks, grid, control)
    if model == "locsca":
        return fit_location_scale(blocks, grid, control)
    if model == "cox":
        return fit_cox(blocks, control)
    return fit_distribution(blocks, model, control)


def observed_quantiles(blocks: Blocks, model: str, control: Control, total: float) -> np.ndarray:
    if model == "cox":
        return km_blocks(blocks, control.reported_quantiles, control.cox_boundary)
    return quantiles(blocks, lambda b: b.y[:, None], 1, control.reported_quantiles, control, total).values


def evaluate(groups: tuple[Blocks, Blocks], fits: tuple[Fit, Fit], model: str, control: Control, with_observed: bool = True) -> tuple[dict, dict, list[dict], float]:
    """Effects, levels, marginalisation rows, and the largest violation of structure + composition = total."""
    total = sum(g.total for g in groups)
    q, rows = {}, []
    for name, fit, blocks in zip(DISTRIBUTIONS, (fits[0], fits[0], fits[1]), (groups[0], groups[1], groups[1])):
        q[name], row = marginal_quantiles(fit, blocks, control.reported_quantiles, control, total)
        rows.append({"distribution": name} | row)
    base, middle, end = (q[n] for n in DISTRIBUTIONS)
    effects = {"structure": end - middle, "composition": middle - base, "total": end - base}
    gap = effects["structure"] + effects["composition"] - effects["total"]
    scale = max(1.0, *(float(np.abs(v[np.isfinite(v)]).max(initial=0.0)) for v in q.values()))
    residual = float(np.abs(gap[np.isfinite(gap)]).max(initial=0.0))
    if residual > IDENTITY * scale:
        raise DecompositionError("the decomposition identity is violated")
    levels = {}
    if with_observed:
        seen = [observed_quantiles(b, model, control, total) for b in groups]
        levels = {
            "reference_observed": seen[0], "reference_model": base, "counterfactual_reference_structure_comparison_X": middle,
            "comparison_observed": seen[1], "comparison_model": end,
        }
    return effects, levels, rows, residual


def estimate_point(groups: tuple[Blocks, Blocks], model: str, solver: str | None, control: Control, with_observed: bool = True) -> Point:
    def fitted(g: int) -> tuple[Fit, dict]:
        began = time.perf_counter()
        fit = fit_group(groups[g], model, solver, control)
        return fit, {"phase": f"group{g}_fit", "elapsed_sec": time.perf_counter() - began, "peak_heap_mb": peak_mb()}

    # large groups are fitted at the same time; their jobs or threads share the machines
    if min(b.rows for b in groups) >= SIDE_BY_SIDE_FROM:
        with ThreadPoolExecutor(2) as pool:
            done = list(pool.map(fitted, range(2)))
    else:
        done = [fitted(g) for g in range(2)]
    fits, resources = [f for f, _ in done], [r for _, r in done]
    began = time.perf_counter()
    effects, levels, rows, residual = evaluate(groups, tuple(fits), model, control, with_observed)
    resources.append({"phase": "marginalization", "elapsed_sec": time.perf_counter() - began, "peak_heap_mb": peak_mb()})
    return Point(tuple(fits), effects, levels, rows, resources, residual)


def peak_mb() -> float:
    """Peak resident memory of this process."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def joins_equal(model: str, solver: str | None, control: Control) -> bool:
    """Whether equal rows may be one with a frequency: in built-in quantile regressions and location models, which say nothing of single rows."""
    custom = solver in solvers or solver == "cuda_admm" or ("linear", control.linear_backend) in backends
    return model in ("qr", "cqr", "loc", "locsca") and not custom


def counterfactual_decompose(
    formula, data: DataFrame, group, weights=None, model: str = "qr", solver: str | None = None, control: Control | None = None, bootstrap_reps: int = 0,
    point_workers: int = 1, bootstrap_workers: int = 1, checkpoint_dir: str | None = None, seed: int = 1, censoring=None, event=None,
) -> Decomposition:
    """Decompose the difference between two groups' outcome distributions.

    ``formula`` names the outcome and the covariates, ``group`` a 0/1 column
    (0: reference). Workers are accepted for compatibility; Spark schedules.
    """
    from countershift.plans.bootstrap import run_bootstrap

    control = control or Control()
    solver = validate(model, solver, control)
    integer("bootstrap_reps", bootstrap_reps, 0)
    for name, value in (("point_workers", point_workers), ("bootstrap_workers", bootstrap_workers)):
        integer(name, value, 1)
    if point_workers > 1 and control.dr_workers > 1 and model in DISTRIBUTION_MODELS:
        raise DecompositionError("use one layer of workers: point_workers or dr_workers")
    began = time.perf_counter()
    prepared = prepare(formula, data, group, weights, model, censoring, event, control.kernel_max_mb, join_equal=joins_equal(model, solver, control))
    try:
        if solver == "auto":
            solver = resolve_solver(solver, prepared.n, len(control.for_model(model)))
        point = estimate_point(prepared.groups, model, solver, control)
        crossing = []
        if model in PROCESS_MODELS and control.crossing_diagnostics:
            for corrected in (False, True) if control.quantile_noncrossing == "rearrange" else (False,):
                for name, fit, blocks in zip(DISTRIBUTIONS, (point.fits[0], point.fits[0], point.fits[1]), (prepared.groups[0], prepared.groups[1], prepared.groups[1])):
                    crossing.append(crossing_row(fit, blocks, name, control, corrected))
        out = Decomposition(model, solver, control, np.array(control.reported_quantiles), point, crossing, _metadata(formula, prepared, model, solver, control, bootstrap_reps, seed, began))
        if bootstrap_reps:
            found = run_bootstrap(prepared, point, model, solver, control, bootstrap_reps, checkpoint_dir, seed, data.sparkSession, str(formula))
            out.draws, out.bootstrap_resources, out.bootstrap_failures = found.draws, found.resources, found.failures
            out.metadata |= {"bootstrap_signature": found.signature, "bootstrap_engine": found.engine}
            out.bands = {e: effect_bands(point.effects[e], found.draws[e], control.alpha, control.robust_se) for e in EFFECTS}
            inside = [q for q in control.reported_quantiles if 0.1 - 1e-12 <= q <= 0.9 + 1e-12]
            if bootstrap_reps > 1 and len(inside) >= 2:
                out.tests = functional_effect_tests(out)
        out.metadata["elapsed_total_sec"] = time.perf_counter() - began
        return out
    finally:
        prepared.release()


def functional_effect_tests(result: Decomposition, constants=(), quantile_range=(0.1, 0.9)) -> list[dict]:
    if result.draws is None or result.reps < 2:
        raise DecompositionError("curve tests need bootstrap draws")
    return functional_tests(result.quantiles, result.point.effects, result.draws, constants, quantile_range, result.control.robust_se)


def _metadata(formula, prepared: Prepared, model, solver, control: Control, reps: int, seed: int, began: float) -> dict:
    from dataclasses import fields
    from datetime import datetime, timezone

    settings = {f"control_{f.name}": getattr(control, f.name) for f in fields(control) if f.name not in ("grid", "full_grid")}
    return {
        "schema_version": SCHEMA_VERSION, "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "formula": str(formula), "model": model, "solver": solver,
        "observations": prepared.n, "observations_reference": int(prepared.groups[0].total), "observations_comparison": int(prepared.groups[1].total), "omitted_rows": prepared.omitted_rows,
        "mean_weight": prepared.mean_weight, "design_columns": list(prepared.columns), "dropped_columns": list(prepared.dropped), "execution_mode": prepared.mode,
        "fit_device": "cpu", "marginal_device": "cpu", "bootstrap_reps": reps, "seed": seed, "elapsed_point_sec": time.perf_counter() - began,
    } | settings

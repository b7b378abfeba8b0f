"""Marginal quantiles: a fitted conditional model averaged over the rows of a group."""

from __future__ import annotations

import numpy as np

from countershift.control import Control
from countershift.functions.curves import correct_cdf, inverse_link, invert_step
from countershift.operators.blocks import Blocks
from countershift.operators.cox import cox_quantiles
from countershift.operators.models import DISTRIBUTION_MODELS, PROCESS_MODELS, Fit
from countershift.operators.selection import quantiles, resolve_method


def distribution_cdf(fit: Fit, blocks: Blocks) -> np.ndarray:
    """Weighted mean probability at every threshold, one pass."""

    def sums(b):
        return b.w @ inverse_link(fit.kind, b.x @ fit.coefficients), np.array([b.w.sum()])

    values, weight = blocks.reduce(sums)
    return values / weight[0]


def marginal_quantiles(fit: Fit, blocks: Blocks, probs, control: Control, legacy_total: float | None = None) -> tuple[np.ndarray, dict]:
    """Quantiles and a diagnostics row (without its ``distribution``)."""
    probs = np.asarray(probs, float)
    empty = dict.fromkeys(("histogram_bins", "candidate_draws", "identified_cdf_max", "dr_noncrossing", "dr_raw_crossing_pairs", "dr_raw_max_crossing", "dr_out_of_bounds_values", "dr_max_bound_adjustment", "dr_corrected_crossing_pairs", "dr_max_adjustment"))
    if fit.kind == "cox":
        out, boundary, top = cox_quantiles(fit, blocks, probs, control.cox_boundary)
        return out, empty | {"method": "cox", "passes": 1, "estimated_matrix_mb": 0.0, "boundary_quantiles": boundary, "identified_cdf_max": top}
    if fit.kind in DISTRIBUTION_MODELS:
        method, mb = resolve_method(control, blocks.rows, 2 * len(fit.grid), blocks)
        t, cdf, changed = correct_cdf(fit.grid, distribution_cdf(fit, blocks), control.dr_noncrossing)
        row = empty | {"method": method, "passes": 1, "estimated_matrix_mb": mb, "boundary_quantiles": 0, "dr_noncrossing": control.dr_noncrossing} | changed.row()
        return invert_step(t, cdf, probs), row
    shift = control.trimming if fit.kind == "qr" and control.legacy_qr_shift else 0.0
    rearrange = control.quantile_noncrossing == "rearrange" and fit.kind in PROCESS_MODELS
    if any(fit.unidentified):
        found, values = _identified_quantiles(fit, blocks, fit.draws(shift, rearrange), probs, control, legacy_total)
        return values, empty | {"method": found.method, "passes": found.passes + 1, "histogram_bins": found.bins, "candidate_draws": found.candidates, "estimated_matrix_mb": found.estimated_mb, "boundary_quantiles": int(np.isnan(values).sum())}
    found = quantiles(blocks, fit.draws(shift, rearrange), fit.draws_per_row, probs, control, legacy_total)
    return found.values, empty | {"method": found.method, "passes": found.passes, "histogram_bins": found.bins, "candidate_draws": found.candidates, "estimated_matrix_mb": found.estimated_mb, "boundary_quantiles": 0}


def _identified_quantiles(fit: Fit, blocks: Blocks, draws, probs: np.ndarray, control: Control, legacy_total: float | None):
    """Quantiles of all draws where only those inside a row's grid are known: their ranks count the others, and what the others could reach is NaN."""
    known, (below, above) = fit.draws_per_row, fit.unidentified
    n = blocks.total * (known + below + above)
    inner = ((n - 1) * probs - below * blocks.total) / (blocks.total * known - 1)
    held = np.flatnonzero((inner >= 0) & (inner <= 1))
    values = np.full(len(probs), np.nan)
    found = quantiles(blocks, draws, known, inner[held] if len(held) else np.array([0.5]), control, legacy_total)
    if len(held):
        values[held] = found.values

    def ends(b):
        v = draws(b)
        return np.array([v[:, 0].max(initial=-np.inf), -v[:, -1].min(initial=np.inf)])

    # a lost draw lies beyond the outermost one of its own row, and that lies inside these two
    low, high = blocks.reduce(ends, np.maximum) * (1, -1)
    reached = (values < low if below else False) | (values > high if above else False)
    return found, np.where(reached, np.nan, values)


def crossing_row(fit: Fit, blocks: Blocks, distribution: str, control: Control, corrected: bool) -> dict:
    """How often neighbouring conditional quantiles of a row decrease by more than the tolerance."""
    pairs, tol = max(0, fit.coefficients.shape[1] - 1), control.crossing_tolerance
    draws = fit.draws(0.0, corrected)

    def sums(b):
        fall = -np.diff(draws(b), axis=1)
        crossed = fall > tol
        any_row = crossed.any(axis=1)
        size = fall[crossed]
        times = np.broadcast_to(b.freq[:, None], crossed.shape)[crossed]
        return np.array([b.freq @ any_row, b.w @ any_row, b.w.sum(), times.sum(), times @ size, size.max(initial=0.0)])

    def combine(a, b):
        return np.append((a + b)[:5], max(a[5], b[5]))

    rows, weighted, weight, count, total, most = blocks.reduce(sums, combine) if pairs else np.zeros(6) + (0, 0, 1, 0, 0, 0)
    n = int(blocks.total)
    return {
        "distribution": distribution, "rows": n, "quantile_pairs": float(n * pairs), "crossing_rows": int(rows), "crossing_row_share": rows / n,
        "weighted_crossing_row_share": weighted / weight, "crossing_pairs": int(count), "crossing_pair_share": count / (n * pairs) if pairs else 0.0,
        "max_crossing": most, "mean_crossing": total / count if count else 0.0, "tolerance": tol,
        "correction": "rearrange" if corrected else "none", "stage": "corrected" if corrected else "raw",
    }

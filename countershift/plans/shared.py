"""Replications of quantile regressions and location models on executors that share every pass.

A row carries its multipliers in all replications as one vector, so a pass over
the rows reduces scores, sums or histograms of all of them together, and the
number of passes doesn't depend on how many there are:

* exact refits start at the point estimate. Rows whose residual is small for
  their leverage form a band; above and below it each replication keeps two
  sums. A task solves a replication's band and sums, and a pass looks for rows
  that the solution puts on the wrong side. Where there are none it is the exact
  solution; the others go on with a band of twice the width, and what is left
  when bands have become wide is fitted on its own;
* a one-step refit moves a quantile up and a quantile down in one pass, with the
  point estimate's Jacobians and every replication's scores;
* location and scale models are sums for all coefficients, then one search for
  all residual quantiles;
* the marginal quantiles of all replications are searched for side by side.

The driver holds coefficients and sums of the design's width per replication;
bands are shuffled to the tasks that solve them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from countershift.control import Control
from countershift.functions.linalg import common_columns, solve_normal
from countershift.functions.ranks import EPS, type7_positions
from countershift.operators import qrkernel
from countershift.operators.blocks import Block, Replications, SparkBlocks
from countershift.operators.models import Fit
from countershift.operators.selection import select_together
from countershift.plans.decompose import Point
from countershift.registry import backends, solvers

#: Replications whose multipliers lie in one table, and quantiles whose bands do.
TOGETHER, BATCH = 256, 8
#: Rows of the first band: so many times the root of (columns x rows), 10 of which are five standard deviations of a resampled fit at the median.
BAND = 12
#: Doublings of a band's width before a replication is fitted on its own.
DOUBLINGS = 6
#: Bins of a band's width on a binary logarithmic scale.
_BINS, _PER_DOUBLING = 1024, 8


@dataclass
class Refits:
    """Coefficients (reps x p x quantiles), which replications have them, and the passes that were made."""

    coefficients: np.ndarray
    good: np.ndarray
    passes: int


@dataclass
class Draws:
    """What fits of all replications say of rows: ``draw(x, replication)`` (rows x per_row), and which replications have one."""

    draw: Callable[[np.ndarray, int], np.ndarray]
    per_row: int
    good: np.ndarray
    passes: int = 3


def sums(blocks: Replications) -> tuple[np.ndarray, np.ndarray]:
    """Weight and Gram matrix of every replication, one pass."""

    def measure(b: Block):
        m = b.w[:, None] * b.freq
        return m.sum(axis=0), np.einsum("ir,ij,ik->rjk", m, b.x, b.x, optimize=True)

    return blocks.reduce(measure)


def full_rank(gram: np.ndarray) -> np.ndarray:
    """Which replications leave no column of the design dependent on the others."""
    out = np.zeros(len(gram), bool)
    for r, g in enumerate(gram):
        scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        factor = np.linalg.qr(np.vstack([np.linalg.cholesky(g / np.outer(scale, scale) + 1e-14 * np.eye(len(g))).T]), mode="r")
        out[r] = len(common_columns(factor, factor)) == len(g) and np.linalg.cond(g / np.outer(scale, scale)) < 1e12
    return out


def exact(blocks: Replications, taus: np.ndarray, centre: np.ndarray, gram: np.ndarray, good: np.ndarray) -> Refits:
    """Exact fits of all good replications at ``taus``, from the point estimate ``centre`` (p x taus)."""
    p, k_all, reps = blocks.p, len(taus), blocks.reps
    root = np.linalg.inv(np.linalg.cholesky(gram[good].mean(axis=0) if good.any() else np.eye(p)))

    def far(b: Block, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals, and these divided by the rows' leverages."""
        r = b.y[:, None] - b.x @ b0
        leverage = np.sqrt(((b.x @ root.T) ** 2).sum(axis=1))
        return r, np.abs(r) / np.maximum(leverage, 1e-300)[:, None]

    def widths(b: Block):
        _, z = far(b, centre)
        with np.errstate(divide="ignore"):
            at = np.clip(np.floor(np.log2(z) * _PER_DOUBLING) + _BINS // 2, 0, _BINS - 1).astype(np.int64)
        return np.stack([np.bincount(at[:, k], minlength=_BINS) for k in range(k_all)])

    rows = np.cumsum(blocks.reduce(widths), axis=1)
    wanted = min(blocks.rows, max(20 * p, int(np.ceil(BAND * np.sqrt(p * blocks.rows)))))
    edge = np.array([int(np.searchsorted(c, wanted)) for c in rows])
    width = 2.0 ** ((edge + 1 - _BINS // 2) / _PER_DOUBLING)
    out = np.full((reps, p, k_all), np.nan)
    passes, open_ = 1, {k: list(np.flatnonzero(good)) for k in range(k_all)}
    for _ in range(DOUBLINGS):
        for at in range(0, k_all, BATCH):
            held = {k: np.array(open_[k]) for k in range(at, min(at + BATCH, k_all)) if len(open_[k])}
            if held:
                found = _solved(blocks, taus, centre, far, width, held)
                wrong = _wrong(blocks, centre, far, width, found)
                passes += 3
                for k, r in held.items():
                    for i, rep in enumerate(r):
                        if not wrong[k][i] and np.isfinite(found[k][1][i]).all():
                            out[rep, :, k] = found[k][1][i]
                    open_[k] = [rep for i, rep in enumerate(r) if not np.isfinite(out[rep, :, k]).all()]
                    if open_[k]:
                        width[k] *= 2
        if not any(open_.values()):
            break
    return Refits(out, good & np.isfinite(out).all(axis=(1, 2)), passes)


def _solved(blocks: Replications, taus, centre, far, width, held: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each quantile: replications and their solutions of band and sums."""
    keys, p = sorted(held), blocks.p

    def outside(b: Block):
        r, z = far(b, centre[:, keys])
        out = []
        for i, k in enumerate(keys):
            m = b.w[:, None] * b.freq[:, held[k]]
            for side in ((z[:, i] > width[k]) & (r[:, i] < 0), (z[:, i] > width[k]) & (r[:, i] >= 0)):
                own = m[side]
                out.append(np.column_stack([own.T @ b.x[side], own.T @ b.y[side], own.sum(axis=0)]))
        return tuple(out)

    globs = blocks.reduce(outside)
    build = blocks._block()
    names = ["pair", *(f"x_{j}" for j in range(p)), "y", "w"]

    def banded(batches):
        import pyarrow as pa

        for batch in batches:
            b = build(batch)
            _, z = far(b, centre[:, keys])
            for i, k in enumerate(keys):
                inside = np.flatnonzero(z[:, i] <= width[k])
                row, rep = np.nonzero(b.freq[inside][:, held[k]] > 0)
                row = inside[row]
                w = b.w[row] * b.freq[row, held[k][rep]]
                yield pa.record_batch([pa.array(i * blocks_reps + held[k][rep], pa.int64()), *(pa.array(b.x[row, j]) for j in range(p)), pa.array(b.y[row]), pa.array(w)], names=names)

    blocks_reps = blocks.reps
    sums_of = {i * blocks_reps + int(rep): (globs[2 * i][n], globs[2 * i + 1][n]) for i, k in enumerate(keys) for n, rep in enumerate(held[k])}

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        pair = int(part["pair"].iloc[0])
        i = pair // blocks_reps
        part = part.sort_values(["y", *names[1:-2], "w"], kind="stable")  # the same rows in the same order, whatever the shuffle did
        w = part["w"].to_numpy()
        x, y = part[names[1:-2]].to_numpy() * w[:, None], part["y"].to_numpy() * w
        for g in sums_of[pair]:
            if g[-1] > 0:
                x, y = np.vstack([x, g[:p]]), np.append(y, g[p])
        b, ok, _ = qrkernel.exact(x, y, taus[keys[i]], centre[:, keys[i]]) if len(y) > p else (np.full(p, np.nan), False, 0)
        return pd.DataFrame({"pair": [pair], "b": [(b if ok else np.full(p, np.nan)).tolist()]})

    bands = blocks.frame.select(*blocks.names).mapInArrow(banded, "pair long, " + ", ".join(f"{n} double" for n in names[1:]))
    solved = {r["pair"]: np.array(r["b"], float) for r in bands.groupBy("pair").applyInPandas(solve, "pair long, b array<double>").collect()}
    nothing = np.full(p, np.nan)
    return {k: (held[k], np.array([solved.get(i * blocks_reps + int(rep), nothing) for rep in held[k]])) for i, k in enumerate(keys)}


def _wrong(blocks: Replications, centre, far, width, found: dict) -> dict[int, np.ndarray]:
    """For each quantile the rows outside the band that each solution puts on the other side."""
    keys = sorted(found)

    def measure(b: Block):
        r, z = far(b, centre[:, keys])
        out = []
        for i, k in enumerate(keys):
            reps, solutions = found[k]
            outside = z[:, i] > width[k]
            now = b.y[outside, None] - b.x[outside] @ np.nan_to_num(solutions).T
            low = (r[outside, i] < 0)[:, None]
            out.append((np.where(low, now > 0, now < 0) & (b.freq[outside][:, reps] > 0)).sum(axis=0))
        return tuple(out)

    return dict(zip(keys, blocks.reduce(measure)))


def onestep(blocks: Replications, fit: Fit, totals: np.ndarray, gram: np.ndarray, good: np.ndarray) -> Refits:
    """One Newton step per quantile with the point estimate's inverse Jacobians and each replication's scores."""
    taus, inverses = np.asarray(fit.grid), fit.info["inverses"]
    start = int(np.argmin(np.abs(taus - 0.5)))
    # the quantiles without a Jacobian are exact fits, all in the same passes
    solved = [start, *(k for k in range(len(taus)) if k != start and k not in inverses)]
    first = exact(blocks, taus[solved], fit.coefficients[:, solved], gram, good)
    out = np.full((blocks.reps, blocks.p, len(taus)), np.nan)
    out[:, :, solved] = first.coefficients
    passes = first.passes
    for distance in range(1, len(taus)):
        sides = [(k, k - s) for k, s in ((start + distance, 1), (start - distance, -1)) if 0 <= k < len(taus) and k not in solved]
        if not sides:
            continue
        before = [np.nan_to_num(out[:, :, q]).T for _, q in sides]

        def measure(b: Block, sides=sides, before=before):
            m = b.w[:, None] * b.freq
            return tuple(b.x.T @ (m * (taus[k] - qrkernel.reached(b.y[:, None], b.x @ c))) for (k, _), c in zip(sides, before))

        for (k, q), score in zip(sides, blocks.reduce(measure)):
            out[:, :, k] = out[:, :, q] + (inverses[k] @ (score / totals)).T
        passes += 1
    return Refits(out, first.good & np.isfinite(out).all(axis=(1, 2)), passes)


def location(blocks: Replications, grid, totals: np.ndarray, gram: np.ndarray, good: np.ndarray, control: Control, scaled: bool) -> Draws:
    """Location (and scale) models of all good replications: sums for the coefficients, and a search for all residual quantiles."""
    reps, eps = np.flatnonzero(good), float(EPS)
    solved = lambda right: np.array([solve_normal(gram[r], right[r]) if good[r] else np.full(blocks.p, np.nan) for r in range(blocks.reps)])
    b = solved(blocks.reduce(lambda k: (k.w[:, None] * k.freq * k.y[:, None]).T @ k.x))
    known = np.nan_to_num(b)
    g = None
    if scaled:

        def spread(k: Block):
            square = np.log(np.maximum((k.y[:, None] - k.x @ known.T) ** 2, eps))
            return (k.w[:, None] * k.freq * square).T @ k.x

        g = solved(blocks.reduce(spread))

    def residuals(k: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        r = reps[i]
        own = np.flatnonzero(k.freq[:, r] > 0)
        e = k.y[own] - k.x[own] @ b[r]
        if scaled:
            e = e / np.maximum(np.sqrt(np.exp(k.x[own] @ g[r])), np.sqrt(eps))
        return e, k.w[own] * k.freq[own, r]

    low, high, fraction = type7_positions(blocks.total, np.asarray(grid, float))
    found = select_together(blocks, residuals, [np.concatenate([low, high])] * len(reps), [blocks.total] * len(reps), control)
    q = np.full((blocks.reps, len(low)), np.nan)
    for r, v in zip(reps, found):
        q[r] = (1 - fraction) * v[: len(low)] + fraction * v[len(low) :]

    def draw(x: np.ndarray, r: int) -> np.ndarray:
        factor = np.sqrt(np.exp(x @ g[r]))[:, None] if scaled else 1.0
        return (x @ b[r])[:, None] + factor * q[r][None, :]

    return Draws(draw, len(low), good & np.isfinite(q).all(axis=1) & np.isfinite(b).all(axis=1))


def process_draws(refits: Refits, control: Control) -> Draws:
    rearrange, b = control.quantile_noncrossing == "rearrange", refits.coefficients
    shift = control.trimming if control.legacy_qr_shift else 0.0

    def draw(x: np.ndarray, r: int) -> np.ndarray:
        v = x @ b[r] + shift
        return np.sort(v, axis=1) if rearrange else v

    return Draws(draw, b.shape[2], refits.good, refits.passes)


def marginals(blocks: Replications, fitted: list[Draws], good: np.ndarray, control: Control) -> list[np.ndarray]:
    """Marginal quantiles (reps x probs) of each of several fits, in shared passes."""
    probs = np.asarray(control.reported_quantiles, float)
    reps, m = np.flatnonzero(good), fitted[0].per_row
    n = blocks.total * m
    low, high, fraction = type7_positions(n, probs)

    def values(b: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        which, r = divmod(i, len(reps))
        own = np.flatnonzero(b.freq[:, reps[r]] > 0)
        return fitted[which].draw(b.x[own], reps[r]).ravel(), np.repeat(b.w[own] * b.freq[own, reps[r]], m)

    count = len(reps) * len(fitted)
    found = select_together(blocks, values, [np.concatenate([low, high])] * count, [n] * count, control)
    out = [np.full((blocks.reps, len(probs)), np.nan) for _ in fitted]
    for i, q in enumerate(found):
        which, r = divmod(i, len(reps))
        out[which][reps[r]] = (1 - fraction) * q[: len(probs)] + fraction * q[len(probs) :]
    return out


def effects(groups: tuple[Replications, Replications], point: Point, engine: str, control: Control) -> tuple[dict[str, np.ndarray], np.ndarray, list[int]]:
    """Effects (reps x quantiles), which replications have them, and the passes of each group's refits."""
    held = [sums(g) for g in groups]
    good = full_rank(held[0][1]) & full_rank(held[1][1])
    fitted = []
    for g, fit, (totals, gram) in zip(groups, point.fits, held):
        if fit.kind in ("loc", "locsca"):
            fitted.append(location(g, fit.grid, totals, gram, good, control, fit.kind == "locsca"))
        elif engine == "onestep":
            fitted.append(process_draws(onestep(g, fit, totals, gram, good), control))
        else:
            fitted.append(process_draws(exact(g, np.asarray(fit.grid), fit.coefficients, gram, good), control))
    good = fitted[0].good & fitted[1].good
    out = {e: np.full((groups[0].reps, len(control.reported_quantiles)), np.nan) for e in ("structure", "composition", "total")}
    if good.any():
        (base,) = marginals(groups[0], [fitted[0]], good, control)
        middle, end = marginals(groups[1], fitted, good, control)
        out = {"structure": end - middle, "composition": middle - base, "total": end - base}
    return out, good, [d.passes for d in fitted]


def supports(model: str, solver: str | None, control: Control, groups) -> bool:
    """Whether replications of these can share passes: built-in quantile regressions and location models on executors."""
    builtin = (model == "qr" and solver not in solvers and solver != "cuda_admm") or (model in ("loc", "locsca") and ("linear", control.linear_backend) not in backends)
    return builtin and not control.legacy_weighted_quantile and all(isinstance(g, SparkBlocks) for g in groups)

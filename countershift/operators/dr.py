"""Distribution regression: one binary model of y <= t for each threshold, all thresholds in one pass per step.

Iteratively reweighted least squares on blocks: a pass brings the weighted gram
matrix, the score and the deviance of every threshold that hasn't converged; the
driver solves p x p systems. Thresholds that a constant response settles take
the intercept direction; separated ones are flagged, not forced.
"""

from __future__ import annotations

import numpy as np

from countershift.control import Control
from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.functions.curves import inverse_link, link
from countershift.functions.linalg import preconditioner, solve_normal, triangular
from countershift.functions.ranks import EPS
from countershift.operators.blocks import GATHER_ROWS, Block, Blocks, LocalBlocks, SparkBlocks
from countershift.operators.models import Fit
from countershift.operators.selection import select_ranks
from countershift.registry import DR_BACKENDS, backends

EDGE = 1e-8


def threshold_places(distinct: int, nreg: int) -> np.ndarray:
    """Zero-based places of the thresholds among the sorted distinct values."""
    if distinct <= nreg:
        return np.arange(distinct)
    inner = nreg - 2
    middle = np.clip(np.floor((np.arange(1, inner + 1) - 0.5) / inner * distinct), 1, distinct).astype(int)
    return np.unique(np.concatenate([[1], middle, [distinct]])) - 1


def select_thresholds(blocks: Blocks, nreg: int, control: Control) -> np.ndarray:
    if isinstance(blocks, LocalBlocks):
        distinct = np.unique(blocks.block.y)
        return distinct[threshold_places(len(distinct), nreg)]
    frame = blocks.frame.select("y").distinct()
    count = frame.count()
    places = threshold_places(count, nreg)
    if count <= nreg:
        return np.sort(np.array([r[0] for r in frame.collect()]))
    lit = "0D as x_0, y, 1D as w, 1D as freq, 0D as cens, 1D as event"
    values = SparkBlocks(frame.selectExpr(*lit.split(", ")), 1, count, float(count))
    return select_ranks(values, lambda b: b.y[:, None], places + 1.0, float(count), control)[0]


def _derivative(model: str, eta: np.ndarray, mu: np.ndarray) -> np.ndarray:
    if model == "logit":
        return mu * (1 - mu)
    if model == "probit":
        return np.exp(-0.5 * eta**2) / np.sqrt(2 * np.pi)
    return np.exp(np.minimum(eta, 700) - np.exp(np.minimum(eta, 700)))


def _deviance(r: np.ndarray, mu: np.ndarray, w: np.ndarray) -> np.ndarray:
    return -2 * (w[:, None] * np.log(np.where(r, mu, 1 - mu))).sum(axis=0)


def fit_binary(blocks: Blocks, model: str, thresholds: np.ndarray, maxit: int, tol: float, direction: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (p x m), codes (0 converged, 2 separated, 1 not converged) and iterations.

    ``direction`` is the intercept in the blocks' coordinates.
    """
    p, m = blocks.p, len(thresholds)
    shares, weight = blocks.reduce(lambda b: (((b.y[:, None] <= thresholds) * b.w[:, None]).sum(axis=0), np.array([b.w.sum()])))
    share = shares / weight[0]
    out, codes, its = np.zeros((p, m)), np.ones(m, int), np.zeros(m, int)
    lowest, highest = blocks.reduce(lambda b: np.array([-b.y.min(initial=np.inf), b.y.max(initial=-np.inf)]), np.maximum) * (-1, 1)
    constant = (thresholds >= highest) | (thresholds < lowest)
    for j in np.flatnonzero(constant):
        out[:, j] = direction * link(model, 1 - EDGE if thresholds[j] >= highest else EDGE)
        codes[j] = 0
    active = np.flatnonzero(~constant)
    for j in active:
        out[:, j] = direction * link(model, float(np.clip(share[j], 1e-6, 1 - 1e-6)))
    if start is not None:
        out[:, active] = start[:, active]
    upper = np.triu_indices(p)
    last, previous = np.full(m, np.inf), out.copy()
    for it in range(1, maxit + 2):
        if not len(active):
            break
        now, t = out[:, active], thresholds[active]

        def step(b: Block):
            r = b.y[:, None] <= t
            eta = b.x @ now
            mu = np.clip(inverse_link(model, eta), 1e-15, 1 - 1e-15)
            slope = np.maximum(_derivative(model, eta, mu), 1e-300)
            variance = mu * (1 - mu)
            weights = b.w[:, None] * slope * slope / variance
            scores = b.x.T @ (b.w[:, None] * (r - mu) * slope / variance)
            pairs = b.x[:, upper[0]] * b.x[:, upper[1]]
            return pairs.T @ weights, scores, _deviance(r, mu, b.w)

        grams, scores, deviance = blocks.reduce(step)
        left = []
        for k, j in enumerate(active):
            worse = deviance[k] > last[j] * (1 + 1e-12) + 1e-12 and np.isfinite(last[j])
            if worse and its[j] < maxit and not np.array_equal(previous[:, j], out[:, j]):
                out[:, j] = (out[:, j] + previous[:, j]) / 2
                its[j] += 1
                left.append(j)
                continue
            if abs(deviance[k] - last[j]) <= tol * (abs(deviance[k]) + 0.1):
                codes[j] = 0
                continue
            if it > maxit:
                continue
            gram = np.zeros((p, p))
            gram[upper] = grams[:, k]
            gram = gram + np.triu(gram, 1).T
            try:
                change = solve_normal(gram, scores[:, k])
            except NotIdentifiedError:
                # weights have vanished: the rows at hand are separated
                codes[j] = 0
                continue
            previous[:, j], last[j] = out[:, j], deviance[k]
            out[:, j] = out[:, j] + change
            its[j] += 1
            left.append(j)
        active = np.array(left, int)
    _flag_separated(blocks, thresholds, out, codes, constant, tol)
    return out, codes, its


def _flag_separated(blocks, thresholds, out, codes, constant, tol) -> None:
    """Code 2 where every signed margin is at least zero (within slack) and one is more."""

    def margins(b: Block):
        eta = b.x @ out
        s = np.where(b.y[:, None] <= thresholds, 1, -1) * eta
        return np.stack([-s.min(axis=0, initial=np.inf), s.max(axis=0, initial=-np.inf), np.abs(eta).max(axis=0, initial=0)])

    least, most, size = blocks.reduce(margins, np.maximum)
    slack = max(tol, 64 * EPS) * np.maximum(1, size)
    codes[(-least >= -slack) & (most > slack) & ~constant] = 2


def fit_distribution(blocks: Blocks, model: str, control: Control) -> Fit:
    thresholds = select_thresholds(blocks, control.nreg, control)
    if model == "lpm":
        return _fit_lpm(blocks, thresholds, control)
    backend = "glm" if control.dr_backend == "auto" else control.dr_backend
    custom = backends.get(("distribution", backend))
    if custom is None and backend not in DR_BACKENDS:
        raise DecompositionError(f"unknown distribution backend {backend!r}")
    transform = np.eye(blocks.p)
    if control.dr_precondition:
        gram = blocks.reduce(lambda b: (b.x * b.w[:, None]).T @ b.x)
        transform = preconditioner(gram, blocks.reduce(lambda b: triangular(b.x * np.sqrt(b.w)[:, None]), lambda a, b: triangular(np.vstack([a, b]))))
    design = blocks.design(transform)
    direction = np.linalg.solve(transform, np.eye(blocks.p)[0])
    if custom is not None:
        coefficients, codes, its = _custom(design, custom, model, thresholds, control)
    else:
        coefficients, codes, its = fit_binary(design, model, thresholds, control.dr_maxit, control.dr_tolerance, direction)
    if (codes == 1).any():
        raise NotIdentifiedError(f"distribution regression did not converge at thresholds {thresholds[codes == 1].tolist()}")
    return Fit(model, thresholds, transform @ coefficients, info={"codes": codes, "iterations": its, "backend": backend})


def _custom(blocks, extension, model, thresholds, control):
    if extension.runs_by_blocks(blocks):
        b = extension.on_blocks(blocks, lambda k: (k.y[:, None] <= thresholds).astype(float), len(thresholds), model)
        return b, np.zeros(len(thresholds), int), np.zeros(len(thresholds), int)
    x, y, w = blocks.gather(lambda b: (b.x, b.y, b.w), GATHER_ROWS)
    out, codes = np.zeros((blocks.p, len(thresholds))), np.zeros(len(thresholds), int)
    for j, t in enumerate(thresholds):
        found = extension.fit(x, (y <= t).astype(float), w, model, None, control.dr_maxit, control.dr_tolerance)
        out[:, j] = np.asarray(found["coefficients"] if isinstance(found, dict) else found, float)
        codes[j] = 1 if isinstance(found, dict) and found.get("converged") is False else 0
    return out, codes, np.zeros(len(thresholds), int)


def _fit_lpm(blocks: Blocks, thresholds: np.ndarray, control: Control) -> Fit:
    """Least squares of all indicators: one factorisation, many right sides, one pass."""
    backend = "qr" if control.linear_backend == "auto" else control.linear_backend
    custom = backends.get(("linear", backend))
    if custom is not None and custom.runs_by_blocks(blocks):
        b = custom.on_blocks(blocks, lambda k: (k.y[:, None] <= thresholds).astype(float), len(thresholds))
    elif custom is not None:
        x, y, w = blocks.gather(lambda b: (b.x, b.y, b.w), GATHER_ROWS)
        b = np.column_stack([custom.solve(x, (y <= t).astype(float), w) for t in thresholds])
    else:
        def sums(b: Block):
            wx = b.x * b.w[:, None]
            return wx.T @ b.x, wx.T @ (b.y[:, None] <= thresholds)

        gram, right = blocks.reduce(sums)
        b = solve_normal(gram, right)
    return Fit("lpm", thresholds, b, info={"codes": np.zeros(len(thresholds), int), "backend": backend})

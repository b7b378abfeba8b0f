"""Censored quantile regression in steps: selection model, then fits on rows whose quantile is surely uncensored."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np

from countershift.control import Control
from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.functions.curves import inverse_link
from countershift.functions.linalg import independent, preconditioner, triangular
from countershift.functions.ranks import EPS
from countershift.operators.blocks import Block, Blocks
from countershift.operators.dr import fit_binary
from countershift.operators.models import Fit
from countershift.operators.qr import fit_process
from countershift.operators.selection import quantiles

FORBIDDEN = ("onestep", "cuda_admm")
#: Quantiles that are fitted at the same time.
SIDE_BY_SIDE = 8


def fit_censored(blocks: Blocks, taus, solver: str, control: Control) -> Fit:
    if solver in FORBIDDEN:
        raise DecompositionError(f"solver {solver!r} can't be used with the cqr model")
    taus = np.asarray(taus, float)
    if control.cqr_right:
        turned = blocks.map_rows(lambda b: b._replace(y=-b.y, cens=-b.cens))
        fit = _left(turned, 1 - taus[::-1], solver, control)
        turned.release()
        lost = fit.unidentified[0]
        return Fit("cqr", taus[: len(taus) - lost], -fit.coefficients[:, ::-1], unidentified=(0, lost), info=fit.info)
    return _left(blocks, taus, solver, control)


def _left(blocks: Blocks, taus: np.ndarray, solver: str, control: Control) -> Fit:
    def counts(b: Block):
        slack = np.sqrt(EPS) * np.maximum(1, np.abs(b.cens))
        free = b.y > b.cens
        return np.array([(b.y < b.cens - slack).sum(), b.freq[free].sum(), b.freq[~free].sum()])

    wrong, free, censored = blocks.reduce(counts)
    if wrong:
        raise DecompositionError("outcomes lie beyond their censoring point")
    if not free or not censored:
        raise NotIdentifiedError("both censored and uncensored rows are needed")
    # the selection model: 1[y > c] by the binary kernel, whose response is 1[value <= 0]
    selection = blocks.map_rows(lambda b: b._replace(y=np.where(b.y > b.cens, -1.0, 1.0)))
    gram = blocks.reduce(lambda b: (b.x * b.w[:, None]).T @ b.x)
    transform = preconditioner(gram, blocks.reduce(lambda b: triangular(b.x * np.sqrt(b.w)[:, None]), lambda a, b: triangular(np.vstack([a, b]))))
    direction = np.linalg.solve(transform, np.eye(blocks.p)[0])
    g, codes, _ = fit_binary(selection.design(transform), "logit", np.array([0.0]), control.dr_maxit, control.dr_tolerance, direction)
    selection.release()
    if codes[0]:
        raise NotIdentifiedError("the selection model is separated or did not converge")
    g = transform @ g[:, 0]
    chance = lambda b: inverse_link("logit", b.x @ g)
    out, kept, lost = np.zeros((blocks.p, len(taus))), [], 0

    def fitted(tau: float) -> tuple[np.ndarray, list[int]]:
        kept: list[int] = []
        eligible = blocks.where(lambda b, tau=tau: chance(b) > 1 - tau)
        if eligible.total <= blocks.p:
            raise NotIdentifiedError(f"too few rows are eligible at quantile {tau:g}")
        cut = _cut(eligible, chance, control.cqr_first_cut, control)
        eligible.release()
        b = _subset(blocks, lambda z, cut=cut: chance(z) >= cut, tau, solver, control)
        for _ in range(control.cqr_nsteps - 2):
            gap = lambda z, b=b: z.x @ b - z.cens
            positive = blocks.where(lambda z, gap=gap: gap(z) > 0)
            if positive.total <= blocks.p:
                raise NotIdentifiedError(f"too few rows are eligible at quantile {tau:g}")
            margin = _cut(positive, gap, control.cqr_later_cut, control)
            positive.release()
            b = _subset(blocks, lambda z, gap=gap, margin=margin: gap(z) >= margin, tau, solver, control, kept)
        return b, kept

    def tried(k: int):
        try:
            return fitted(taus[k])
        except NotIdentifiedError as e:
            return e

    # from the top, some side by side; fewer rows are surely uncensored at lower quantiles still
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        for top in range(len(taus), 0, -SIDE_BY_SIDE):
            places = range(top - 1, max(top - 1 - SIDE_BY_SIDE, -1), -1)
            for k, found in zip(places, list(pool.map(tried, places))):
                if isinstance(found, NotIdentifiedError):
                    if control.cqr_boundary == "error" or k == len(taus) - 1:
                        raise found
                    lost = k + 1
                    break
                out[:, k], rows = found
                kept += reversed(rows)
            if lost:
                break
    return Fit("cqr", taus[lost:], out[:, lost:], unidentified=(lost, 0), info={"solver": solver, "kept_rows": kept[::-1], "selection": g})


def _cut(blocks: Blocks, value, share: float, control: Control) -> float:
    """The share's quantile, less what rounding may put between it and equal values, which all stay or go together."""
    cut = float(quantiles(blocks, lambda b: value(b)[:, None], 1, [share], Control(marginal_method=control.marginal_method)).values[0])
    return cut - 1e-12 * max(1.0, abs(cut))


def _subset(blocks: Blocks, keep, tau: float, solver: str, control: Control, kept: list | None = None) -> np.ndarray:
    part = blocks.where(keep)
    if part.total <= blocks.p or part.rows < blocks.p:
        raise NotIdentifiedError(f"too few rows are selected at quantile {tau:g}")
    scale = part.reduce(lambda b: np.abs(b.x).max(axis=0, initial=0.0), np.maximum)
    r = part.reduce(lambda b: triangular(b.x / np.where(scale > 0, scale, 1)), lambda a, b: triangular(np.vstack([a, b])))
    if not independent(r, list(range(blocks.p))):
        raise NotIdentifiedError(f"the design of the rows selected at quantile {tau:g} is not of full rank")
    if kept is not None:
        kept.append(int(part.total))
    fit = fit_process(part, [tau], solver, control)
    part.release()
    return fit.coefficients[:, 0]

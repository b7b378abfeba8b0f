"""Location and location-scale models: weighted least squares and residual quantiles."""

from __future__ import annotations

import numpy as np

from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.functions.linalg import solve_normal, triangular
from countershift.functions.ranks import EPS
from countershift.operators.blocks import GATHER_ROWS, Block, Blocks
from countershift.operators.models import Fit
from countershift.operators.selection import quantiles
from countershift.registry import backends

LINEAR_BACKENDS = ("qr", "chol", "fastglm")


def least_squares(blocks: Blocks, backend: str = "qr", response=None) -> np.ndarray:
    """Weighted least squares of ``response(block)`` (y, unless given) by normal equations or by stacked R factors."""
    target = response or (lambda b: b.y)
    backend = "qr" if backend == "auto" else backend
    custom = backends.get(("linear", backend))
    if custom is not None and custom.runs_by_blocks(blocks):
        return custom.on_blocks(blocks, lambda b: np.asarray(target(b), float)[:, None], 1)[:, 0]
    if custom is not None:
        x, z, w = blocks.gather(lambda b: (b.x, target(b), b.w), GATHER_ROWS)
        return custom.solve(x, z, w)
    if backend not in LINEAR_BACKENDS:
        raise DecompositionError(f"unknown linear backend {backend!r}")
    if backend == "qr":
        # the R factor of the joint matrix holds R and Q'z; it squares no condition number
        joint = lambda b: triangular(np.column_stack([b.x, target(b)]) * np.sqrt(b.w)[:, None])
        r = blocks.reduce(joint, lambda a, b: triangular(np.vstack([a, b])))
        p = blocks.p
        return np.linalg.solve(r[:p, :p], r[:p, p])
    gram, right = blocks.reduce(lambda b: ((b.x * b.w[:, None]).T @ b.x, (b.x * b.w[:, None]).T @ target(b)))
    return solve_normal(gram, right)


def fit_location(blocks: Blocks, grid, control: Control) -> Fit:
    b = least_squares(blocks, control.linear_backend)
    found = quantiles(blocks, lambda k: (k.y - k.x @ b)[:, None], 1, grid, _plain(control))
    return Fit("loc", np.asarray(grid), b[:, None], residuals=found.values)


def fit_location_scale(blocks: Blocks, grid, control: Control) -> Fit:
    b = least_squares(blocks, control.linear_backend)
    log_square = lambda k: np.log(np.maximum((k.y - k.x @ b) ** 2, EPS))
    scale = least_squares(blocks, control.linear_backend, log_square)

    def standardised(k: Block) -> np.ndarray:
        return ((k.y - k.x @ b) / np.maximum(np.sqrt(np.exp(k.x @ scale)), np.sqrt(EPS)))[:, None]

    found = quantiles(blocks, standardised, 1, grid, _plain(control))
    return Fit("locsca", np.asarray(grid), b[:, None], residuals=found.values, scale=scale)


def _plain(control: Control) -> Control:
    """Residual quantiles always follow the type-7 rule and the chunked method where rows are on executors."""
    return control if not control.legacy_weighted_quantile else Control(nreg=control.nreg, trimming=control.trimming)

"""Small dense linear algebra on the driver: rank, common columns, preconditioning."""

from __future__ import annotations

from collections import deque

import numpy as np

from countershift.errors import NotIdentifiedError
from countershift.functions.ranks import EPS

RANK_TOLERANCE = 1e-10


def triangular(x: np.ndarray) -> np.ndarray:
    """The R factor of a QR factorisation: what is needed of a block to judge its columns."""
    return np.linalg.qr(x, mode="r") if len(x) else np.zeros((0, x.shape[1]))


def independent(columns: np.ndarray, subset: list[int], tol: float = RANK_TOLERANCE) -> bool:
    """Whether the named columns (of unit largest entries) are linearly independent."""
    if not subset:
        return True
    a = columns[:, subset]
    if a.shape[0] < a.shape[1]:
        return False
    return bool(_rank(a, tol) == len(subset))


def _rank(a: np.ndarray, tol: float) -> int:
    """Columns taken in order, each kept if enough of it is left after projecting out those before."""
    a, kept = np.array(a, float), 0
    norms = np.linalg.norm(a, axis=0)
    basis = np.zeros((a.shape[0], 0))
    for j in range(a.shape[1]):
        v = a[:, j]
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        size = np.linalg.norm(v)
        if norms[j] > 0 and size > tol * norms[j]:
            basis, kept = np.column_stack([basis, v / size]), kept + 1
    return kept


def common_columns(first: np.ndarray, second: np.ndarray, intercept: int = 0, tol: float = RANK_TOLERANCE) -> list[int]:
    """Largest column set that is independent in both matrices (matroid intersection by shortest augmenting paths).

    The intercept is put in first and never exchanged; among direct additions
    the lowest index wins.
    """
    p = first.shape[1]
    chosen = [intercept]
    if not (independent(first, chosen, tol) and independent(second, chosen, tol)):
        raise NotIdentifiedError("the intercept is not identified in both groups")
    while True:
        outside = [j for j in range(p) if j not in chosen]
        source = [j for j in outside if independent(first, [*chosen, j], tol)]
        sink = {j for j in outside if independent(second, [*chosen, j], tol)}
        direct = [j for j in source if j in sink]
        if direct:
            chosen.append(direct[0])
            continue
        # exchange graph: out -> in if second stays independent, in -> out if first does
        parent: dict[int, int | None] = {j: None for j in source}
        queue, end = deque(source), None
        while queue and end is None:
            node = queue.popleft()
            if node in sink and node not in chosen:
                end = node
                break
            if node in chosen:
                rest = [c for c in chosen if c != node]
                steps = [j for j in outside if j not in parent and independent(first, [*rest, j], tol)]
            else:
                steps = [c for c in chosen if c != intercept and c not in parent and independent(second, [*[k for k in chosen if k != c], node], tol)]
            for step in steps:
                parent[step] = node
                queue.append(step)
        if end is None:
            return sorted(chosen)
        path: set[int] = set()
        while end is not None:
            path ^= {end}
            end = parent[end]
        chosen = sorted(set(chosen) ^ path)


def preconditioner(gram: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
    """T such that X T has orthonormal columns, from X'X, or from X's R factor where X'X is too ill-conditioned."""
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    scaled = gram / np.outer(size, size)
    if 1 / np.linalg.cond(scaled) >= EPS ** (2 / 3):
        return np.linalg.inv(np.linalg.cholesky(gram).T)
    if factor is None:
        raise NotIdentifiedError("the design is too ill-conditioned")
    return np.linalg.inv(factor)


def solve_normal(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve normal equations after scaling their diagonal to one."""
    size = np.sqrt(np.diag(gram))
    if not (size > 0).all():
        raise NotIdentifiedError("a design column is zero")
    scaled = gram / np.outer(size, size)
    try:
        factor = np.linalg.cholesky(scaled)
    except np.linalg.LinAlgError:
        raise NotIdentifiedError("the weighted design is singular") from None
    y = (right.T / size).T
    return (np.linalg.solve(factor.T, np.linalg.solve(factor, y)).T / size).T

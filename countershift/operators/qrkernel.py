"""Quantile regression of one matrix in memory: interior point, vertex polish, one-step process, ADMM."""

from __future__ import annotations

import numpy as np

from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.functions.curves import normal_density, normal_quantile
from countershift.functions.ranks import EPS, weighted_type2


def interior_point(x: np.ndarray, y: np.ndarray, tau: float, maxit: int = 200, tol: float = 1e-12) -> tuple[np.ndarray, bool, int]:
    """Primal-dual predictor-corrector for the bounded dual of quantile regression (weights already in x and y).

    The dual variable a lies in [0, 1] with X'a = (1 - tau) X'1; u and v are the
    multipliers of its two bounds.
    """
    n, p = x.shape
    cost, right = -y, (1 - tau) * x.sum(axis=0)
    a = np.full(n, 1 - tau)
    room = 1 - a
    beta = np.linalg.lstsq(x, cost, rcond=None)[0]
    rest = cost - x @ beta
    rest[rest == 0] = 1e-3 * max(1e-8, np.abs(rest).max(initial=0.0))
    u, v = np.maximum(rest, 0) + 1e-10, np.maximum(-rest, 0) + 1e-10
    scale = 1 + np.abs(cost).sum()
    for it in range(maxit):
        gap = cost @ a - beta @ right + v.sum()
        if abs(gap) <= tol * scale:
            return -beta, True, it
        q = 1 / (u / a + v / room)
        slack = cost - x @ beta - u + v
        # predictor
        residual = slack + u - v
        gram = (x * q[:, None]).T @ x
        try:
            factor = np.linalg.cholesky(gram)
        except np.linalg.LinAlgError:
            return -beta, False, it
        infeasible = right - x.T @ a

        def direction(extra, factor=factor, q=q, infeasible=infeasible):
            rhs = x.T @ (q * extra) + infeasible
            db = np.linalg.solve(factor.T, np.linalg.solve(factor, rhs))
            return db, q * (x @ db - extra)

        db, da = direction(residual)
        du, dv = -u - u / a * da, -v + v / room * da
        fp, fd = _step(a, da, room), _step2(u, du, v, dv)
        if min(fp, fd) < 1:
            mu = a @ u + room @ v
            after = (a + fp * da) @ (u + fd * du) + (room - fp * da) @ (v + fd * dv)
            target = (after / mu) ** 2 * after / (2 * n)
            ca, cr = target / a - da * du / a, target / room + da * dv / room
            extra = residual - ca + cr
            db, da = direction(extra)
            du, dv = ca - u - u / a * da, cr - v + v / room * da
            fp, fd = _step(a, da, room), _step2(u, du, v, dv)
        # a step may end on a bound by rounding
        a, room = np.maximum(a + fp * da, 1e-16), np.maximum(room - fp * da, 1e-16)
        beta, u, v = beta + fd * db, np.maximum(u + fd * du, 1e-300), np.maximum(v + fd * dv, 1e-300)
        if not np.isfinite(beta).all():
            return -beta, False, it
    return -beta, False, maxit


def _step(a, da, room) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(da < 0, -a / da, np.inf).min()
        high = np.where(da > 0, room / da, np.inf).min()
    return float(min(0.99995 * min(low, high), 1.0))


def _step2(u, du, v, dv) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(du < 0, -u / du, np.inf).min()
        high = np.where(dv < 0, -v / dv, np.inf).min()
    return float(min(0.99995 * min(low, high), 1.0))


def objective(x, y, tau, b) -> float:
    r = y - x @ b
    return float(np.sum(r * (tau - (r < 0))))


def polish(x: np.ndarray, y: np.ndarray, tau: float, b: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, bool]:
    """Move to a basic solution and pivot until no direction along its edges descends.

    A basis is p rows with zero residual. Its dual values must lie in
    [tau - 1, tau]; where one doesn't, its row leaves and the step along the edge
    ends where the directional derivative turns positive.
    """
    n, p = x.shape
    scale = np.linalg.norm(x, axis=1)
    r = np.abs(y - x @ b) / np.maximum(scale, 1e-300)
    basis, span = [], np.zeros((0, p))
    for i in np.argsort(r, kind="stable")[: max(50 * p, 200)]:
        v = x[i] - (x[i] @ span.T) @ span
        v = v - (v @ span.T) @ span
        if np.linalg.norm(v) > 1e-9 * scale[i] and scale[i] > 0:
            basis.append(int(i))
            span = np.vstack([span, v / np.linalg.norm(v)])
            if len(basis) == p:
                break
    if len(basis) < p:
        return b, False
    for _ in range(rounds):
        inverse = np.linalg.inv(x[basis])
        b = inverse @ y[basis]
        r = y - x @ b
        r[basis] = 0
        r[np.abs(r) <= 1e-11 * (np.abs(y) + np.abs(x) @ np.abs(b))] = 0
        psi = np.where(r > 0, tau, np.where(r < 0, tau - 1, 0.0))
        dual = -(psi @ x) @ inverse
        loose = np.flatnonzero(r == 0)
        loose = loose[~np.isin(loose, basis)]
        slopes_up, slopes_down = 1 - tau + dual, tau - dual  # derivative when a basis row's residual falls, or rises
        if len(loose):
            # rows that also have residual zero resist in either direction
            edge = x[loose] @ inverse
            slopes_up = slopes_up + (np.maximum(-edge, 0) * tau + np.maximum(edge, 0) * (1 - tau)).sum(axis=0)
            slopes_down = slopes_down + (np.maximum(edge, 0) * tau + np.maximum(-edge, 0) * (1 - tau)).sum(axis=0)
        slack = 1e-10 * (1 + np.abs(dual).max())
        worst = min((float(slopes_up.min()), int(slopes_up.argmin()), 1.0), (float(slopes_down.min()), int(slopes_down.argmin()), -1.0))
        if worst[0] >= -slack:
            return b, True
        slope, k, sign = worst
        move = x @ (inverse[:, k] * sign)  # residuals change by -t * move
        move[basis] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(move != 0, r / move, np.inf)
        hit = np.flatnonzero((t > 0) & np.isfinite(t) & (np.abs(move) > 1e-13 * scale))
        hit = hit[np.argsort(t[hit], kind="stable")]
        if not len(hit):
            return b, False
        gains = np.cumsum(np.abs(move[hit])) + slope
        at = hit[min(int(np.searchsorted(gains, 0)), len(hit) - 1)]
        basis[k] = int(at)
        if abs(np.linalg.det(x[basis] / scale[basis, None])) < 1e-13:
            return b, False
    return b, False


def exact(x: np.ndarray, y: np.ndarray, tau: float, start: np.ndarray | None = None) -> tuple[np.ndarray, bool, int]:
    """Interior point and polish; the better of the two solutions. With a start near the solution polish alone may do."""
    if start is not None:
        b, ok = polish(x, y, tau, start, rounds=60)
        if ok:
            return b, True, 0
    inner, converged, its = interior_point(x, y, tau)
    if not np.isfinite(inner).all():
        inner = np.linalg.lstsq(x, y, rcond=None)[0]
    b, ok = polish(x, y, tau, inner)
    if ok or objective(x, y, tau, b) <= objective(x, y, tau, inner):
        return b, ok or converged, its
    return inner, converged, its


def certificate(x: np.ndarray, y: np.ndarray, tau: float, b: np.ndarray, directions: np.ndarray | None = None) -> float:
    """Least directional derivative of the objective at b over plus and minus the given directions (0 or more: optimal)."""
    r = y - x @ b
    r[np.abs(r) <= 1e-8 * (1 + np.abs(y).max())] = 0
    least = np.inf
    for d in np.vstack([np.eye(x.shape[1]), -np.eye(x.shape[1])] if directions is None else [directions, -directions]):
        m = x @ d
        least = min(least, float((np.where(r > 0, -tau, np.where(r < 0, 1 - tau, 0)) * m).sum() + np.where(r == 0, np.maximum(-tau * m, (1 - tau) * m), 0).sum()))
    return least


def band(tau: float, n: float, rule: str, sd: float, iqr: float) -> float | None:
    """Bandwidth on the residual scale, or None where it is unusable."""
    z = normal_quantile(tau)
    f = normal_density(z)
    if rule == "bofinger":
        h = n ** (-1 / 5) * (4.5 * f**4 / (2 * z * z + 1) ** 2) ** (1 / 5)
    else:
        h = n ** (-1 / 3) * normal_quantile(0.975) ** (2 / 3) * (1.5 * f * f / (2 * z * z + 1)) ** (1 / 3)
    if tau - h < 0.001:
        h = tau / 2
    if tau + h > 0.999:
        h = (1 - tau) / 2
    width = (normal_quantile(tau + h) - normal_quantile(tau - h)) * min(sd, iqr / 1.34)
    return width if np.isfinite(width) and width > 0 else None


def reached(y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Whether outcomes are at most their fit; those that a fit passes through are, whatever the last bits say."""
    return y - fit <= 1e-10 * (np.abs(y) + np.abs(fit))


def residual_scale(r: np.ndarray, w: np.ndarray, n: float | None = None) -> tuple[float, float]:
    """Weighted standard deviation (n / (n - 1)) and interquartile range."""
    mean = np.average(r, weights=w)
    n = len(r) if n is None else n
    sd = np.sqrt(np.average((r - mean) ** 2, weights=w) * n / max(n - 1, 1))
    low, high = weighted_type2(r, w, [0.25, 0.75])
    return float(sd), float(high - low)


def onestep_process(x, y, w, taus, rule: str = "hall_sheather", first=None, n: float | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """An exact fit nearest the median, then one Newton step from each tau to the next; ``n`` counts repeated rows. Coefficients, exact flags, inverse Jacobians by place."""
    taus = np.asarray(taus, float)
    spacing = np.diff(taus).max(initial=0.0)
    if spacing > 0.0501:
        raise DecompositionError("the one-step process needs quantiles at most 0.05 apart")
    n, p = len(y) if n is None else n, x.shape[1]
    start = int(np.argmin(np.abs(taus - 0.5)))
    out, fell_back, inverses = np.zeros((p, len(taus))), np.zeros(len(taus), bool), {}
    wx, wy = x * w[:, None], y * w
    out[:, start] = (first or exact)(wx, wy, taus[start])[0]
    for sequence in (range(start + 1, len(taus)), range(start - 1, -1, -1)):
        previous = start
        for k in sequence:
            r = y - x @ out[:, previous]
            h = band(taus[previous], n, rule, *residual_scale(r, w, n))
            step = None
            if h is not None:
                kernel = np.exp(-0.5 * (r / h) ** 2) / np.sqrt(2 * np.pi) / h * w
                jacobian = (x * kernel[:, None]).T @ x / n
                if np.isfinite(jacobian).all() and 1 / np.linalg.cond(jacobian) > EPS:
                    inverse = np.linalg.inv(jacobian)
                    score = (w * (taus[k] - reached(y, x @ out[:, previous]))) @ x / n
                    step = inverse @ score
            if step is None or not np.isfinite(step).all():
                out[:, k] = exact(wx, wy, taus[k], out[:, previous])[0]
                fell_back[k] = True
            else:
                out[:, k] = out[:, previous] + step
                inverses[k] = inverse
            previous = k
    return out, fell_back, inverses


def admm(x, y, tau, rho: float = 1.0, maxit: int = 5000, tol: float = 1e-6) -> tuple[np.ndarray, bool, int]:
    """Alternating directions with one factorisation; approximate, on request only."""
    scale = np.abs(y).max() or 1.0
    t = y / scale
    gram = x.T @ x
    b, r, u = np.zeros(x.shape[1]), t.copy(), np.zeros(len(t))
    for it in range(1, maxit + 1):
        b = np.linalg.solve(gram, x.T @ (t - r + u))
        fit = x @ b
        v = t - fit + u
        before = r
        r = np.where(v > tau / rho, v - tau / rho, np.where(v < (tau - 1) / rho, v - (tau - 1) / rho, 0.0))
        u = u + t - fit - r
        if max(np.linalg.norm(t - fit - r), rho * np.linalg.norm(r - before)) <= tol * np.sqrt(len(t)):
            return b * scale, True, it
    return b * scale, False, maxit


def check_rows(n: float, p: int) -> None:
    if n <= p:
        raise NotIdentifiedError("fewer observations than coefficients")

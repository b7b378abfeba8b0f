"""Weighted order statistics in memory; the distributed forms are in ``operators.selection``."""

from __future__ import annotations

import numpy as np

from countershift.errors import DecompositionError

EPS = float(np.finfo(float).eps)
#: Weights that are added one by one; sums of so many are added in a second level.
STRETCH = 4096
#: Bits of a weight that a double adds without rounding, 2^27 times.
LEADING_BITS = 26


def tolerance(total: float) -> float:
    """Slack of a rank comparison on cumulative weights that add up to ``total``."""
    return 64 * EPS * max(1.0, total)


def first_reaching(cumulative: np.ndarray, targets: np.ndarray, total: float) -> np.ndarray:
    """Index of the first cumulative weight that reaches each target, the last one if none does."""
    at = np.searchsorted(cumulative, np.asarray(targets) - tolerance(total), side="left")
    return np.minimum(at, len(cumulative) - 1)


def type7_positions(n: float, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower rank, upper rank and the fraction between them for ``n`` unit-weight values."""
    position = 1 + (n - 1) * np.asarray(probs, float)
    low = np.maximum(np.floor(position), 1)
    return low, np.minimum(low + 1, n), position - np.floor(position)


def running_sum(w: np.ndarray) -> np.ndarray:
    """Running sums whose error stays below the rank tolerance: extended precision, in stretches, since equal weights round alike and their errors add up."""
    stretches = -(-len(w) // STRETCH)
    out = np.zeros((stretches, STRETCH), np.longdouble)
    out.ravel()[: len(w)] = w
    np.cumsum(out, axis=1, out=out)
    out[1:] += np.cumsum(out[:-1, -1])[:, None]
    return out.ravel()[: len(w)]


def sums_by_key(key: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """``bincount`` of weights, whose leading bits are added without rounding."""
    top = w.max(initial=0.0)
    if not top > 0:
        return np.bincount(key, w, size)
    unit = 2.0 ** (np.ceil(np.log2(top)) - LEADING_BITS)
    leading = np.round(w / unit) * unit
    return np.bincount(key, leading, size) + np.bincount(key, w - leading, size)


def weighted_type7(x, weights, probs, n: float | None = None) -> np.ndarray:
    """Type-7 quantiles where weights are scaled to sum to ``n`` (the number of values, unless given)."""
    x, w = np.asarray(x, float), np.asarray(weights, float)
    if not np.isfinite(x).all():
        raise DecompositionError("quantiles of non-finite values")
    n = float(len(x) if n is None else n)
    order = np.argsort(x, kind="stable")
    running = running_sum(w[order])
    x, cumulative = x[order], (running * (n / running[-1])).astype(float)
    cumulative[-1] = n
    low, high, fraction = type7_positions(n, probs)
    return (1 - fraction) * x[first_reaching(cumulative, low, n)] + fraction * x[first_reaching(cumulative, high, n)]


def weighted_type2(x, weights, probs) -> np.ndarray:
    """Quantiles that average the two values where the cumulative weight meets the target exactly."""
    x, back = np.unique(np.asarray(x, float), return_inverse=True)
    cumulative = np.cumsum(np.bincount(back, np.asarray(weights, float)))
    targets = np.asarray(probs, float) * cumulative[-1]
    at = np.minimum(np.searchsorted(cumulative, targets, side="left"), len(x) - 1)
    following = np.minimum(at + 1, len(x) - 1)
    return np.where(cumulative[at] == targets, (x[at] + x[following]) / 2, x[at])


def legacy_quantile(x, weights, probs) -> np.ndarray:
    """Scale-sensitive rule: positions 1 + (W - 1) p on the cumulated weights W of distinct values."""
    x, back = np.unique(np.asarray(x, float), return_inverse=True)
    cumulative = np.cumsum(np.bincount(back, np.asarray(weights, float)))
    position = 1 + (cumulative[-1] - 1) * np.asarray(probs, float)
    low = np.maximum(np.floor(position), 1)
    high, fraction = np.minimum(low + 1, cumulative[-1]), position % 1
    step = lambda t: x[np.minimum(np.searchsorted(cumulative, t, side="left"), len(x) - 1)]
    return (1 - fraction) * step(low) + fraction * step(high)

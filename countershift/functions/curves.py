"""Corrections and inversion of step distribution functions, links, and the normal law."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import erfc, sqrt
from statistics import NormalDist

import numpy as np

from countershift.checks import choice

_normal = NormalDist()
normal_quantile, normal_density = _normal.inv_cdf, _normal.pdf
_erfc = np.frompyfunc(erfc, 1, 1)

LINKS = ("logit", "probit", "cloglog", "lpm")


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / sqrt(2)).astype(float)


def inverse_link(name: str, eta: np.ndarray) -> np.ndarray:
    """Probability for a linear predictor."""
    if name == "logit":
        return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    if name == "probit":
        return normal_cdf(eta)
    if name == "cloglog":
        return -np.expm1(-np.exp(np.minimum(eta, 700)))
    return np.asarray(eta, float)


def link(name: str, p: float) -> float:
    """Linear predictor for a probability."""
    if name == "logit":
        return float(np.log(p) - np.log1p(-p))
    if name == "probit":
        return normal_quantile(p)
    if name == "cloglog":
        return float(np.log(-np.log1p(-p)))
    return p


@dataclass(frozen=True)
class Correction:
    raw_crossing_pairs: int
    raw_max_crossing: float
    out_of_bounds_values: int
    max_bound_adjustment: float
    corrected_crossing_pairs: int
    max_adjustment: float

    def row(self) -> dict:
        return {f"dr_{k}": v for k, v in asdict(self).items()}


def isotonic(values: np.ndarray) -> np.ndarray:
    """Least-squares increasing fit with equal weights: pool neighbours that decrease."""
    levels: list[list[float]] = []  # mean, size
    for v in values:
        levels.append([float(v), 1])
        while len(levels) > 1 and levels[-2][0] > levels[-1][0]:
            (a, n), (b, m) = levels[-2:]
            levels[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return np.repeat([m for m, _ in levels], [n for _, n in levels])


def correct_cdf(thresholds, cdf, method: str = "cummax") -> tuple[np.ndarray, np.ndarray, Correction]:
    """Sorted thresholds, the corrected values, and what was changed."""
    choice("method", method, ("cummax", "rearrange", "isotonic", "none"))
    order = np.argsort(thresholds, kind="stable")
    t, raw = np.asarray(thresholds, float)[order], np.asarray(cdf, float)[order]
    falls = -np.diff(raw)
    clipped = np.clip(raw, 0, 1)
    fixed = {"cummax": np.maximum.accumulate, "rearrange": np.sort, "isotonic": isotonic, "none": np.array}[method](clipped)
    fixed = np.clip(fixed, 0, 1)
    left = -np.diff(fixed)
    return t, fixed, Correction(
        int((falls > 0).sum()), float(max(falls.max(initial=0.0), 0.0)), int(((raw < 0) | (raw > 1)).sum()), float(np.abs(clipped - raw).max(initial=0.0)),
        int((left > 0).sum()), float(np.abs(fixed - raw).max(initial=0.0)),
    )


def invert_step(thresholds: np.ndarray, cdf: np.ndarray, probs) -> np.ndarray:
    """First threshold whose value reaches each probability, else the last; no rank tolerance."""
    reaches = np.asarray(cdf)[None, :] >= np.asarray(probs, float)[:, None]
    at = np.where(reaches.any(axis=1), reaches.argmax(axis=1), len(thresholds) - 1)
    return np.asarray(thresholds, float)[at]

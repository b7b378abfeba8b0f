"""Standard errors, pointwise and uniform bands, and curve tests from bootstrap draws (replications x quantiles)."""

from __future__ import annotations

import warnings

import numpy as np

from countershift.errors import DecompositionError
from countershift.functions.curves import normal_quantile
from countershift.functions.ranks import EPS
from countershift.schemas import EFFECTS


def _spread(draws: np.ndarray, robust: bool) -> np.ndarray:
    """Standard deviation, or interquartile range over 1.34, of each column's finite draws (two at least)."""
    out = np.full(draws.shape[1], np.nan)
    for k, column in enumerate(draws.T):
        fine = column[np.isfinite(column)]
        if len(fine) >= 2:
            out[k] = np.subtract(*np.percentile(fine, [75, 25])) / 1.34 if robust else fine.std(ddof=1)
    return out


def effect_bands(estimate: np.ndarray, draws: np.ndarray, alpha: float = 0.05, robust: bool = False) -> dict[str, np.ndarray]:
    """Columns of the decomposition table for one effect."""
    identified = np.isfinite(estimate)
    finite = np.isfinite(draws)
    effective = np.where(identified, finite.sum(axis=0), 0)
    se = np.where(identified, _spread(draws, robust), np.nan)
    z = normal_quantile(1 - alpha / 2)
    support = identified & np.isfinite(se) & finite.all(axis=0)
    critical = np.nan
    if support.any():
        moving = support & (se > 0)
        critical = 0.0
        if moving.any():
            critical = float(np.quantile((np.abs(draws[:, moving] - estimate[moving]) / se[moving]).max(axis=1), 1 - alpha))
    half = np.where(support, critical * se, np.nan)
    return {
        "identified": identified, "std_error": se, "pointwise_lower": estimate - z * se, "pointwise_upper": estimate + z * se,
        "uniform_lower": estimate - half, "uniform_upper": estimate + half, "bootstrap_reps_effective": effective,
    }


def curve_statistics(draws: np.ndarray, observed: np.ndarray, variance_draws: np.ndarray, robust: bool) -> tuple[float, float, float, float]:
    """KS and CMS statistics with their p-values (share of draws strictly above)."""
    parts = np.vstack([draws, observed[None, :], variance_draws])
    scale = np.abs(np.where(np.isfinite(parts), parts, 0)).max(axis=0)
    scale[scale == 0] = 1
    variance = np.maximum(_spread(variance_draws, robust) ** 2, 64 * EPS * scale**2)
    square, own = draws**2 / variance, observed**2 / variance
    ks, cms = np.sqrt(own.max()), own.mean()
    return float(ks), float((np.sqrt(square.max(axis=1)) > ks).mean()), float(cms), float((square.mean(axis=1) > cms).mean())


def functional_tests(quantiles: np.ndarray, point: dict[str, np.ndarray], draws: dict[str, np.ndarray], constants=(), quantile_range=(0.1, 0.9), robust: bool = False) -> list[dict]:
    """Rows for each effect: zero, each constant, constant across quantiles, nonnegative, nonpositive."""
    low, high = quantile_range
    if not 0 < low < high < 1:
        raise DecompositionError("quantile_range must lie in (0, 1)")
    inside = (quantiles >= low - 1e-12) & (quantiles <= high + 1e-12)
    rows: list[dict] = []
    for effect in EFFECTS:
        usable = inside & np.isfinite(point[effect]) & np.isfinite(draws[effect]).all(axis=0)
        if usable.sum() < 2:
            warnings.warn(f"{effect}: fewer than two usable quantiles", stacklevel=2)
            continue
        q, own, all_draws = quantiles[usable], point[effect][usable], draws[effect][:, usable]
        centred = all_draws - own
        middle = int(np.argmin(np.abs(q - 0.5)))
        others = np.arange(len(q)) != middle
        cases = [("zero_effect", 0.0, centred, own, centred)]
        cases += [("constant_effect", float(c), centred, own - c, centred) for c in constants]
        flat = (centred - centred[:, [middle]])[:, others]
        cases.append(("constant_across_quantiles", np.nan, flat, (own - own[middle])[others], flat))
        cases.append(("nonnegative_effect", 0.0, np.minimum(centred, 0), np.minimum(own, 0), centred))
        cases.append(("nonpositive_effect", 0.0, np.maximum(centred, 0), np.maximum(own, 0), centred))
        for test, null, numerator, observed, variance in cases:
            ks, ks_p, cms, cms_p = curve_statistics(numerator, observed, variance, robust)
            rows.append({
                "effect": effect, "test": test, "null_value": null, "quantile_min": float(q.min()), "quantile_max": float(q.max()), "quantiles_tested": numerator.shape[1],
                "bootstrap_reps": len(numerator), "ks_statistic": ks, "ks_p_value": ks_p, "cms_statistic": cms, "cms_p_value": cms_p,
            })
    return rows

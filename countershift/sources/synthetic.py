"""Gaussian two-group designs with known effects, made where they are used."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from countershift.errors import DecompositionError
from countershift.functions.curves import normal_quantile
from countershift.schemas import EFFECTS


@dataclass(frozen=True)
class Scenario:
    """x ~ N(mu_g, x_sd); y = a_g + b_g x + N(0, sigma)."""

    name: str
    mu: tuple[float, float]
    a: tuple[float, float]
    b: tuple[float, float]
    sigma: float = 1.0
    x_sd: float = 1.0

    def truth(self, probs) -> dict[str, np.ndarray]:
        z = np.array([normal_quantile(p) for p in probs])
        level = lambda m, x: self.a[m] + self.b[m] * self.mu[x] + z * np.hypot(self.b[m] * self.x_sd, self.sigma)
        base, middle, end = level(0, 0), level(0, 1), level(1, 1)
        return dict(zip(EFFECTS, (end - middle, middle - base, end - base)))


# The three validation designs.
SCENARIOS = (
    Scenario("location_shift", (0.0, 0.0), (0.0, 0.20), (0.50, 0.50)),
    Scenario("composition_shift", (0.0, 0.50), (0.0, 0.0), (0.60, 0.60)),
    Scenario("combined_scale_shift", (0.0, 0.50), (0.0, 0.15), (0.50, 0.80), sigma=0.80),
)


def scenario(name: str) -> Scenario:
    for s in SCENARIOS:
        if s.name == name:
            return s
    raise DecompositionError(f"no scenario {name!r}")


def draw(s: Scenario, n_per_group: int, seed: int, weighted: bool = True) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for g in (0, 1):
        x = rng.normal(s.mu[g], s.x_sd, n_per_group)
        y = s.a[g] + s.b[g] * x + rng.normal(0, s.sigma, n_per_group)
        parts.append(pd.DataFrame({"y": y, "x": x, "group": g, "weight": rng.uniform(0.5, 1.5, n_per_group) if weighted else 1.0}))
    return pd.concat(parts, ignore_index=True)


def scenario_table(spark: SparkSession, name: str, n_per_group: int, seed: int = 1, weighted: bool = True, partitions: int = 8) -> DataFrame:
    """A design of any size: each partition draws its own share from (seed, partition)."""
    s, per = scenario(name), -(-n_per_group // partitions)

    def run(frames):
        for frame in frames:
            for part in frame["id"]:
                n = max(0, min(per, n_per_group - int(part) * per))
                yield draw(s, n, seed * 100_003 + int(part), weighted)

    return spark.range(0, partitions, 1, partitions).mapInPandas(run, "y double, x double, group int, weight double")

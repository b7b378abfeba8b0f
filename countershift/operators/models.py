"""What a conditional model leaves behind, and its draws."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from countershift.operators.blocks import Block

MODELS = ("qr", "cqr", "loc", "locsca", "logit", "probit", "cloglog", "lpm", "cox")
PROCESS_MODELS = ("qr", "cqr")
DISTRIBUTION_MODELS = ("logit", "probit", "cloglog", "lpm")


@dataclass
class Fit:
    """``grid``: quantiles, or thresholds of a distribution model; empty for the others."""

    kind: str
    grid: np.ndarray
    coefficients: np.ndarray  # p x len(grid); one column for location models and Cox
    residuals: np.ndarray | None = None
    scale: np.ndarray | None = None
    baseline: object | None = None  # a Cox model's, in memory or a table
    shift: float = 0.0
    unidentified: tuple[int, int] = (0, 0)  # quantiles below and above the grid that a row has too, whose values are not known
    info: dict = field(default_factory=dict)

    def release(self) -> None:
        """Free what lies on executors."""
        if self.baseline is not None:
            self.baseline.release()

    @property
    def draws_per_row(self) -> int:
        return len(self.residuals) if self.residuals is not None else self.coefficients.shape[1]

    def draws(self, trimming: float = 0.0, rearrange: bool = False):
        """A function from a block to its rows' conditional quantiles; ``trimming`` is the legacy shift of QR draws."""
        kind, b, q, g = self.kind, self.coefficients, self.residuals, self.scale

        def run(block: Block) -> np.ndarray:
            if kind == "loc":
                return (block.x @ b) + q[None, :]
            if kind == "locsca":
                return (block.x @ b) + np.sqrt(np.exp(block.x @ g))[:, None] * q[None, :]
            out = block.x @ b
            if kind == "qr" and trimming:
                out = out + trimming
            return np.sort(out, axis=1) if rearrange else out

        return run

    def tidy(self, columns: list[str], group: int) -> list[tuple[int, float, str, float]]:
        """(group, grid value, term, coefficient) rows."""
        grid = self.grid if self.coefficients.shape[1] == len(self.grid) else [float("nan")]
        return [(group, float(t), c, float(self.coefficients[j, k])) for k, t in enumerate(grid) for j, c in enumerate(columns)]

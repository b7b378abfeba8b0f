"""Exact weighted quantiles of values or of all draws of all rows, without sorting them.

Range, then a histogram of weights and counts, then the few values in the bins
that hold the wanted ranks. While those bins hold too many values, they alone
are divided into bins again. In memory and few draws: one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.functions.ranks import first_reaching, legacy_quantile, sums_by_key, tolerance, type7_positions, weighted_type7
from countershift.operators.blocks import Block, Blocks, LocalBlocks

#: Times that ranges are divided; doubles have no more to divide then.
MAX_LEVELS = 12
Draws = Callable[[Block], np.ndarray]  # rows x draws


@dataclass
class Selection:
    values: np.ndarray
    method: str
    passes: int
    bins: int | None
    candidates: int | None
    estimated_mb: float


def _weights(draws: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.repeat(w, draws.shape[1])


def resolve_method(control: Control, rows: int, draws: int, blocks: Blocks) -> tuple[str, float]:
    mb = rows * draws * 8 / 2**20
    if control.legacy_weighted_quantile:
        return "matrix", mb
    method = control.marginal_method
    if method == "auto":
        method = "matrix" if mb <= control.marginal_matrix_max_mb else "chunked"
    # rows on executors are never brought together
    return ("chunked" if not isinstance(blocks, LocalBlocks) else method), mb


def quantiles(blocks: Blocks, draws: Draws, m: int, probs, control: Control, legacy_total: float | None = None) -> Selection:
    """Type-7 quantiles of ``m`` draws per row; ranks are those of ``blocks.total * m`` values."""
    n = blocks.total * m
    method, mb = resolve_method(control, blocks.rows, m, blocks)
    if method == "matrix":
        block = blocks.block
        values = draws(block)
        w = _weights(values, block.w)
        if control.legacy_weighted_quantile:
            # pre-divided by the prepared rows of both groups
            out = legacy_quantile(values.ravel(), w / (legacy_total or n), probs)
        else:
            out = weighted_type7(values.ravel(), w, probs, n)
        return Selection(out, method, 1, None, None, mb)
    low, high, fraction = type7_positions(n, probs)
    found, bins, passes, candidates = select_ranks(blocks, draws, np.concatenate([low, high]), n, control)
    k = len(low)
    return Selection((1 - fraction) * found[:k] + fraction * found[k:], method, passes, bins, candidates, mb)


def _divided(v: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int) -> np.ndarray:
    wide = np.maximum(hi - lo, np.finfo(float).tiny)
    return cell * parts + np.clip(np.floor((v - lo[cell]) / wide[cell] * parts), 0, parts - 1).astype(np.int64)


def _summed(values: np.ndarray, cell: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal values of a cell once, with their weights' sum, in order."""
    order = np.lexsort((values, cell))
    values, cell, w = values[order], cell[order], w[order]
    first = np.flatnonzero(np.append(True, (np.diff(values) != 0) | (np.diff(cell) != 0))[: len(values)])
    return values[first], cell[first], np.add.reduceat(w, first) if len(first) else w


class RankSearch:
    """A search for the values at which cumulative weight (scaled to sum to ``n``) reaches each rank, a pass at a time.

    ``measure`` is what a pass takes from some values and weights, ``merge``
    joins two of them, ``advance`` takes the whole pass; many searches can share
    passes. Cells are ranges that hold a rank; each level divides them, so
    values that lie close together cost a level and no more.
    """

    def __init__(self, ranks: np.ndarray, n: float, bins: int, limit: int):
        self.ranks, self.n, self.bins, self.limit = ranks, n, bins, limit
        self.phase, self.passes, self.levels, self.scale, self.candidates = "spread", 0, [], None, 0
        self.found: np.ndarray | None = None

    def _located(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that lie in a cell, and their cells."""
        at, cell = np.arange(len(v)), np.zeros(len(v), np.int64)
        for lo, hi, parts, following in self.levels:
            cell = following[_divided(v[at], cell, lo, hi, parts)]
            at, cell = at[cell >= 0], cell[cell >= 0]
        return at, cell

    @property
    def parts(self) -> int:
        return max(256, self.bins // len(self.lows))

    def measure(self, v: np.ndarray, w: np.ndarray):
        if self.phase == "spread":
            if not np.isfinite(v).all():
                raise DecompositionError("quantiles of non-finite values")
            return np.array([-v.min(initial=np.inf), v.max(initial=-np.inf)])
        at, cell = self._located(v)
        if self.phase == "histogram":
            key, size = _divided(v[at], cell, self.lows, self.highs, self.parts), self.parts * len(self.lows)
            return np.stack([sums_by_key(key, w[at], size), np.bincount(key, minlength=size).astype(float)])
        return _summed(v[at], cell, w[at])

    def merge(self, a, b):
        if self.phase == "spread":
            return np.maximum(a, b)
        return a + b if self.phase == "histogram" else _summed(*(np.concatenate(x) for x in zip(a, b)))

    def advance(self, whole) -> None:
        self.passes += 1
        if self.phase == "spread":
            bottom, top = whole * (-1, 1)
            self.lows, self.highs, self.below, self.above = np.array([bottom]), np.array([top]), np.zeros(1), np.array([float(self.n)])
            self.owner, self.phase = np.zeros(len(self.ranks), np.int64), "histogram"
            if bottom == top:
                self.found, self.phase = np.full(len(self.ranks), bottom), "done"
        elif self.phase == "histogram":
            self._narrow(*whole)
        else:
            self._pick(*whole)

    def _narrow(self, weights: np.ndarray, counts: np.ndarray) -> None:
        parts, size = self.parts, self.parts * len(self.lows)
        running = np.cumsum(weights.reshape(-1, parts), axis=1, dtype=np.longdouble)
        self.scale = self.n / running[0, -1] if self.scale is None else self.scale
        cumulative = (self.below[:, None] + running * self.scale).astype(float)
        # rounding must not leave a rank behind the last value of its cell
        last = parts - 1 - (counts.reshape(-1, parts)[:, ::-1] > 0).argmax(axis=1)
        cumulative = np.where(np.arange(parts) >= last[:, None], self.above[:, None], cumulative)
        targets = np.array([c * parts + int(first_reaching(cumulative[c], self.ranks[[k]], self.n)[0]) for k, c in enumerate(self.owner)])
        wanted, self.owner = np.unique(targets, return_inverse=True)
        self.candidates = int(counts[wanted].sum())
        following = np.full(size, -1)
        following[wanted] = np.arange(len(wanted))
        self.levels.append((self.lows, self.highs, parts, following))
        cell, place = np.divmod(wanted, parts)
        width = (self.highs - self.lows)[cell] / parts
        self.above = cumulative.ravel()[wanted]
        self.below = np.where(place > 0, cumulative.ravel()[np.maximum(wanted - 1, 0)], self.below[cell])
        self.lows, self.highs = self.lows[cell] + place * width, self.lows[cell] + (place + 1) * width
        if self.candidates <= self.limit or len(self.levels) >= MAX_LEVELS:
            self.phase = "collect"

    def _pick(self, values: np.ndarray, cell: np.ndarray, w: np.ndarray) -> None:
        if len(values) > self.limit:
            raise DecompositionError("too many distinct values share the wanted ranges; raise marginal_candidate_max")
        self.found = np.empty(len(self.ranks))
        for k, (c, rank) in enumerate(zip(self.owner, self.ranks)):
            inside = cell == c
            running = self.below[c] + np.cumsum(w[inside]) * float(self.scale)
            running[-1] = self.above[c]
            self.found[k] = values[inside][min(int(np.searchsorted(running, rank - tolerance(self.n))), inside.sum() - 1)]
        self.phase = "done"


def select_ranks(blocks: Blocks, draws: Draws, ranks: np.ndarray, n: float, control: Control) -> tuple[np.ndarray, int, int, int]:
    """The value at which cumulative weight (scaled to sum to ``n``) reaches each rank, bins, passes and candidates."""
    search = RankSearch(ranks, n, control.marginal_histogram_bins, control.marginal_candidate_max)
    while search.phase != "done":

        def measure(b: Block, s=search):
            v = draws(b)
            return s.measure(v.ravel(), _weights(v, b.w))

        search.advance(blocks.reduce(measure, search.merge))
    return search.found, control.marginal_histogram_bins, search.passes, search.candidates


def select_together(blocks: Blocks, values: Callable[[Block, int], tuple[np.ndarray, np.ndarray]], ranks: list[np.ndarray], n: list[float], control: Control) -> list[np.ndarray]:
    """Several selections that share their passes: ``values(block, i)`` are the values and weights of the i-th."""
    count = max(1, len(ranks))
    searches = [RankSearch(r, m, max(256, control.marginal_histogram_bins // count), max(1000, control.marginal_candidate_max // count)) for r, m in zip(ranks, n)]
    while open_ := {i: s for i, s in enumerate(searches) if s.phase != "done"}:

        def measure(b: Block, held=open_):
            return {i: s.measure(*values(b, i)) for i, s in held.items()}

        def merge(a: dict, b: dict, held=open_):
            return {i: s.merge(a[i], b[i]) for i, s in held.items()}

        for i, whole in blocks.reduce(measure, merge).items():
            searches[i].advance(whole)
    return [s.found for s in searches]

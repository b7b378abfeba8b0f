"""The linear quantile-regression process: solver choice, and exact fits of rows that stay on the executors."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.functions.linalg import preconditioner, triangular
from countershift.functions.ranks import running_sum, tolerance, type7_positions
from countershift.operators import qrkernel
from countershift.operators.blocks import GATHER_ROWS, Block, Blocks, LocalBlocks
from countershift.operators.models import Fit
from countershift.operators.selection import _summed, quantiles
from countershift.registry import QR_SOLVERS, solvers

#: Quantiles whose bands one pass brings to the driver together.
BATCH = 8
#: Rows of one quantile's problem that are solved at once. Where a pilot from so many would leave wider bands, it is fitted over larger and larger samples.
SOLVED_ROWS = 150_000
#: Problems of one group that are solved at the same time.
SOLVERS = 4
#: Residuals that a pass of the one-step process brings from around a quartile.
WINDOW_ROWS = 100_000
#: Repairs of a whole process's bands before all quantiles are fitted again.
PROCESS_ROUNDS = 4
#: Rows in memory from which fits are preprocessed too.
GLOB_FROM = 20_000


def resolve_solver(solver: str, n: float, taus: int) -> str:
    if solver == "auto":
        if taus < 10:
            return "br" if n < 10_000 else "pfn"
        return "qfnb" if n < 10_000 else "pfnb"
    if solver not in QR_SOLVERS and solver not in solvers:
        raise DecompositionError(f"unknown solver {solver!r}")
    return solver


def effective_weights(w: np.ndarray, freq: np.ndarray, total: float, mean: float, rows: int) -> np.ndarray:
    """w f normalised to mean one, times the mean frequency."""
    wf = w * freq
    return wf / mean * (total / rows)


def fit_process(blocks: Blocks, taus, solver: str = "auto", control: Control | None = None) -> Fit:
    """Weights of the blocks are final (frequencies are already in them)."""
    control = control or Control()
    taus = np.asarray(taus, float)
    name = resolve_solver(solver, blocks.total, len(taus))
    qrkernel.check_rows(blocks.total, blocks.p)
    custom = solvers.get(name)
    if custom is not None and custom.runs_by_blocks(blocks):
        b = custom.on_blocks(blocks, lambda k: k.y[:, None], len(taus), taus)
        return Fit("qr", taus, b, info={"solver": name, "exact": custom.exact, "converged": True})
    if custom is not None:
        x, y, w = blocks.gather(lambda b: (b.x, b.y, b.w), GATHER_ROWS)
        b, report = custom.process(x, y, w, taus)
        return Fit("qr", taus, b, info={"solver": name, "exact": custom.exact, "converged": True, **report})
    if name == "onestep":
        return _onestep(blocks, taus, control)
    if name == "cuda_admm" and not isinstance(blocks, LocalBlocks):
        raise DecompositionError("cuda_admm works on rows in memory; choose an exact solver, or raise kernel_max_mb")
    transform = np.eye(blocks.p)
    if control.qr_precondition and name != "cuda_admm":
        gram = blocks.reduce(lambda b: (b.x * b.w[:, None]).T @ (b.x * b.w[:, None]))
        transform = preconditioner(gram, blocks.reduce(lambda b: triangular(b.x * b.w[:, None]), lambda a, b: triangular(np.vstack([a, b]))))
    design = blocks.design(transform)
    more = {}
    if isinstance(design, LocalBlocks) and (design.rows < GLOB_FROM or name == "cuda_admm"):
        b, converged, its = _local(design.block, taus, name, control)
    elif name in ("proqreg", "profn"):
        b, converged, its, more = _process(design, taus)
    else:
        b, converged, its = _globbed(design, taus)
    if name == "cuda_admm" and not converged.all() and not control.gpu_qr_allow_nonconvergence:
        raise DecompositionError("alternating directions did not converge")
    return Fit("qr", taus, transform @ b, info={"solver": name, "exact": QR_SOLVERS[name][1], "converged": bool(converged.all()), "codes": (~converged).astype(int), "iterations": its} | more)


def _local(block: Block, taus, name: str, control: Control):
    x, y = block.x * block.w[:, None], block.y * block.w
    out, ok, its = np.zeros((x.shape[1], len(taus))), np.zeros(len(taus), bool), np.zeros(len(taus), int)
    warm = name in ("qfnb", "pfnb", "proqreg", "profn", "br")
    order = np.argsort(np.abs(taus - 0.5), kind="stable") if warm else np.arange(len(taus))
    done: list[int] = []
    for k in order:
        if name == "cuda_admm":
            out[:, k], ok[k], its[k] = qrkernel.admm(x, y, taus[k], control.gpu_qr_rho, control.gpu_qr_maxit, control.gpu_qr_tolerance)
            continue
        near = [j for j in done if abs(taus[j] - taus[k]) < 0.06]
        start = out[:, min(near, key=lambda j: abs(taus[j] - taus[k]))] if warm and near else None
        out[:, k], ok[k], its[k] = qrkernel.exact(x, y, taus[k], start)
        done.append(int(k))
    return out, ok, its


def _process(blocks: Blocks, taus: np.ndarray):
    """The whole process from one preprocessing: all quantiles' bands in one pass, a row once however many bands it lies in.

    Each exact fit starts the next one's. Where a quantile can't be proved in a
    few repairs, all of them are fitted again, a batch at a time, and the reason
    stands in the diagnostics.
    """
    try:
        out, ok, its, left = _globbed_in(blocks, taus, len(taus), _bands_once, PROCESS_ROUNDS)
        reason = f"{len(left)} quantiles had rows on the wrong side after {PROCESS_ROUNDS} repairs" if left else None if ok.all() else "a reduced problem was not solved"
    except (DecompositionError, np.linalg.LinAlgError) as e:
        reason = str(e)
    if reason is None:
        return out, ok, its, {"process_fallback": None}
    return *_globbed(blocks, taus), {"process_fallback": reason}


def _globbed(blocks: Blocks, taus: np.ndarray, sample=None):
    """Exact fits, a batch of quantiles at a time; what no bracket proves is fitted from all rows, up to the limit of a gather."""
    out, ok, its, left = _globbed_in(blocks, taus, BATCH, _bands, 12, sample)
    if left:
        x, y, w = blocks.gather(lambda b: (b.x, b.y, b.w), GATHER_ROWS)
        for k in left:
            out[:, k], ok[k], its[k] = qrkernel.exact(x * w[:, None], y * w, taus[k], out[:, k])
    return out, ok, its


def sample_sizes(n: float, p: int) -> list[int]:
    """Rows of the samples that pilots are fitted on: one that is solved whole, then such that a fit of each leaves a band of about ``SOLVED_ROWS`` of the next."""
    sizes = [int(min(n, max(p + 1, 20 * p, min(SOLVED_ROWS, np.floor(n ** (2 / 3) * np.sqrt(p))))))]
    while 1.5 * sizes[-1] <= (reached := SOLVED_ROWS / 3 * np.sqrt(sizes[-1] / p)) < n:
        sizes.append(int(reached))
    return sizes


def _drawn(b: Block, rate: float) -> np.ndarray:
    """Whether rows are in a sample: by a hash of their values, whatever task reads them, so that a smaller sample is part of a larger one."""
    mixed = (np.column_stack([b.x, b.y, b.w]) + 0.0).view(np.uint64)
    h = np.zeros(len(b.y), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(mixed.shape[1]):
            h = (h ^ mixed[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / 2**53 < rate


def _sample(blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted rows and outcomes, and the weights, of the first sample."""
    rate = min(1.0, 1.2 * sample_sizes(blocks.rows, blocks.p)[0] / blocks.rows)

    def sampled(b: Block):
        keep = _drawn(b, rate)
        return b.x[keep] * b.w[keep, None], b.y[keep] * b.w[keep], b.w[keep]

    return blocks.gather(sampled, GATHER_ROWS)


def _globbed_in(blocks: Blocks, taus: np.ndarray, together: int, bands, rounds: int, sample=None):
    """Exact fits by globbing: a pilot from a sample brackets each fit; rows surely above or below become two rows.

    A pass returns, for a batch of quantiles, the rows in the band and the sums of
    the others. The reduced problem is solved exactly; another pass looks for
    globbed rows on the wrong side. A few of them make the solution the next
    pilot; many, a wider band around the old one; until there are none. Pilots of
    large groups are fitted over several samples in the same way but for that
    search, so that what a pass returns hardly grows with the group.
    """
    n, p = blocks.rows, blocks.p
    sizes = sample_sizes(n, p)
    sx, sy, sw = _sample(blocks) if sample is None else sample
    together = max(1, int(together * min(1.0, SOLVED_ROWS / (3 * np.sqrt(p / sizes[-1]) * n))))
    out, ok, its = np.zeros((p, len(taus))), np.zeros(len(taus), bool), np.zeros(len(taus), int)
    unproved: list[int] = []
    for at in range(0, len(taus), together):
        batch = list(range(at, min(at + together, len(taus))))
        reach, lows, highs = dict.fromkeys(batch, 1.0), {}, {}
        pilots = dict(zip(batch, _side_by_side(lambda k: qrkernel.exact(sx, sy, taus[k])[0], batch, n)))
        fitted_on = dict.fromkeys(batch, len(sy))

        def bracket(k, least, reach=reach, lows=lows, highs=highs, pilots=pilots, fitted_on=fitted_on):
            r = np.sort((sy - sx @ pilots[k]) / sw)
            half = reach[k] * max(least, 3 * np.sqrt(p * taus[k] * (1 - taus[k]) / fitted_on[k]))
            # a pilot's residuals are zero at its quantile, whatever rank that has among the sample's
            under, over = np.searchsorted(r, 0.0), np.searchsorted(r, 0.0, side="right")
            wide = int(np.ceil(max(half * len(r), p + 1)))
            lows[k] = r[under - wide] if under >= wide else -np.inf
            highs[k] = r[over + wide - 1] if over + wide <= len(r) else np.inf

        def solved(reduced, batch, pilots=pilots):
            def fit(k):
                rows, target, below, above = reduced[k]
                xs, ys = np.vstack([rows, below[:p], above[:p]]), np.concatenate([target, [below[p], above[p]]])
                used = np.concatenate([np.ones(len(rows), bool), [bool(below[p + 1]), bool(above[p + 1])]])
                return qrkernel.exact(xs[used], ys[used], taus[k], pilots[k])

            return zip(batch, _side_by_side(fit, batch, n))

        for size in sizes[1:]:
            for k in batch:
                bracket(k, 0.0)
            for k, (b, fine, _) in solved(bands(blocks, batch, pilots, lows, highs, size / n), batch):
                before, now = (sy - sx @ pilots[k]) / sw, sy - sx @ b
                strayed = ((before < lows[k]) & (now > 0)) | ((before > highs[k]) & (now < 0))
                if fine and strayed.sum() <= 0.1 * ((before >= lows[k]) & (before <= highs[k])).sum():
                    pilots[k], fitted_on[k] = b, size
        for _ in range(rounds):
            if not batch:
                break
            for k in batch:
                bracket(k, sizes[0] / (2 * n))
            reduced = bands(blocks, batch, pilots, lows, highs)
            for k, found in solved(reduced, batch):
                out[:, k], ok[k], its[k] = found
            wrong = _wrong(blocks, batch, pilots, lows, highs, out)
            left = [k for k in batch if wrong[k]]
            for k in left:
                if wrong[k] <= 0.1 * len(reduced[k][1]):
                    pilots[k] = out[:, k].copy()
                else:  # the band has missed the fit, which says nothing about where it is
                    reach[k] *= 2
            batch = left
        unproved += batch
    return out, ok, its, unproved


def _side_by_side(fn, batch, n: int) -> list:
    """``fn`` of every quantile of a batch: in threads where the group is large, since the matrix operations are most of the work."""
    if n < GLOB_FROM or len(batch) < 2:
        return [fn(k) for k in batch]
    with ThreadPoolExecutor(min(len(batch), os.cpu_count() or 1, SOLVERS)) as pool:
        return list(pool.map(fn, batch))


def _bands(blocks: Blocks, batch, pilots, lows, highs, rate: float = 1.0):
    p = blocks.p

    def run(b: Block):
        if rate < 1:
            keep = _drawn(b, rate)
            b = Block(*(v[keep] for v in b))
        wx, wy = b.x * b.w[:, None], b.y * b.w

        def one(k):
            r = b.y - b.x @ pilots[k]
            under, over = r < lows[k], r > highs[k]
            inside = ~under & ~over
            sums = [np.concatenate([wx[m].sum(axis=0), [wy[m].sum(), m.sum()]]) for m in (under, over)]
            return wx[inside], wy[inside], *sums

        return {k: one(k) for k in batch}

    def combine(a, b):
        if sum(len(a[k][1]) + len(b[k][1]) for k in a) > GATHER_ROWS:
            raise DecompositionError("more rows near the fits than the limit of a gather")
        return {k: (np.vstack([a[k][0], b[k][0]]), np.concatenate([a[k][1], b[k][1]]), a[k][2] + b[k][2], a[k][3] + b[k][3]) for k in a}

    return blocks.reduce(run, combine) or {k: (np.zeros((0, p)), np.zeros(0), np.zeros(p + 2), np.zeros(p + 2)) for k in batch}


def _bands_once(blocks: Blocks, batch, pilots, lows, highs, rate: float = 1.0):
    """As :func:`_bands`, with each row once: its membership in the bands is a bit mask."""
    p = blocks.p

    def run(b: Block):
        if rate < 1:
            keep = _drawn(b, rate)
            b = Block(*(v[keep] for v in b))
        wx, wy = b.x * b.w[:, None], b.y * b.w
        r = b.y[:, None] - b.x @ np.column_stack([pilots[k] for k in batch])
        under, over = r < np.array([lows[k] for k in batch]), r > np.array([highs[k] for k in batch])
        inside = ~under & ~over
        some = inside.any(axis=1)
        full = np.column_stack([wx, wy, np.ones(len(wy))])
        return wx[some], wy[some], np.packbits(inside[some], axis=1), under.T @ full, over.T @ full

    def combine(a, b):
        if len(a[1]) + len(b[1]) > GATHER_ROWS:
            raise DecompositionError("more rows near the fits than the limit of a gather")
        return tuple(np.concatenate([x, y]) for x, y in zip(a[:3], b[:3])) + (a[3] + b[3], a[4] + b[4])

    x, y, bits, below, above = blocks.reduce(run, combine)
    inside = np.unpackbits(bits, axis=1, count=len(batch)).astype(bool)
    return {k: (x[inside[:, i]], y[inside[:, i]], below[i], above[i]) for i, k in enumerate(batch)}


def _wrong(blocks: Blocks, batch, pilots, lows, highs, out) -> dict[int, int]:
    def run(b: Block):
        counts = np.zeros(len(batch))
        for i, k in enumerate(batch):
            r, now = b.y - b.x @ pilots[k], b.y - b.x @ out[:, k]
            counts[i] = ((r < lows[k]) & (now > 0)).sum() + ((r > highs[k]) & (now < 0)).sum()
        return counts

    return dict(zip(batch, blocks.reduce(run).astype(int).tolist()))


def _onestep(blocks: Blocks, taus: np.ndarray, control: Control) -> Fit:
    """The one-step process: per quantile a pass for the scale and one for Jacobian and score, each for the next quantile up and the next one down."""
    if isinstance(blocks, LocalBlocks):
        b = blocks.block
        out, fell, inverses = qrkernel.onestep_process(b.x, b.y, b.w, taus, control.onestep_bandwidth, n=blocks.total)
        return Fit("qr", taus, out, info={"solver": "onestep", "exact": False, "converged": True, "fallbacks": fell, "inverses": inverses})
    if np.diff(taus).max(initial=0.0) > 0.0501:
        raise DecompositionError("the one-step process needs quantiles at most 0.05 apart")
    start = int(np.argmin(np.abs(taus - 0.5)))
    out, fell, inverses = np.zeros((blocks.p, len(taus))), np.zeros(len(taus), bool), {}
    sample = _sample(blocks)
    out[:, [start]] = _globbed(blocks, taus[[start]], sample)[0]
    n = blocks.total
    exact = lambda b: quantiles(blocks, lambda z: (z.y - z.x @ b)[:, None], 1, QUARTILES, control).values
    first = exact(out[:, start])
    walks = [_Walk(places, start, _Quartiles(sample, n, out[:, start], first)) for places in (range(start + 1, len(taus)), range(start - 1, -1, -1))]
    # both directions share every pass
    for step in range(max(len(walk.places) for walk in walks)):
        moving = [walk for walk in walks if step < len(walk.places)]
        bs = [out[:, walk.previous].copy() for walk in moving]
        spans = [walk.quartiles.windows(b) for walk, b in zip(moving, bs)]

        def scales(z, bs=bs, spans=spans):
            found = []
            for b, windows in zip(bs, spans):
                r = z.y - z.x @ b
                inside = [(r >= lo) & (r <= hi) for lo, hi in windows]
                found.append((np.array([z.w.sum(), z.w @ r, z.w @ r**2, *(z.w[r < lo].sum() for lo, _ in windows)]), [(r[m], z.w[m]) for m in inside]))
            return found

        def merged(a, b):
            return [(s + t, [_joined(x, y) for x, y in zip(u, v)]) for (s, u), (t, v) in zip(a, b)]

        bandwidths = []
        for walk, b, (sums, held) in zip(moving, bs, blocks.reduce(scales, merged)):
            s0, s1, s2 = sums[:3]
            sd = np.sqrt(max(s2 / s0 - (s1 / s0) ** 2, 0) * n / (n - 1))
            low, high = walk.quartiles.found(held, sums[3:], s0) or walk.quartiles.learnt(exact(b))
            bandwidths.append(qrkernel.band(taus[walk.previous], n, control.onestep_bandwidth, sd, high - low))
        steps = [(i, b, h, taus[walk.places[step]]) for i, (walk, b, h) in enumerate(zip(moving, bs, bandwidths)) if h is not None]

        def sums(z, steps=steps):
            found = []
            for _, b, h, tau in steps:
                fitted = z.x @ b
                kernel = np.exp(-0.5 * ((z.y - fitted) / h) ** 2) / np.sqrt(2 * np.pi) / h * z.w
                found.append(((z.x * kernel[:, None]).T @ z.x, (z.w * (tau - qrkernel.reached(z.y, fitted))) @ z.x))
            return found

        held = dict(zip((i for i, *_ in steps), blocks.reduce(sums))) if steps else {}
        for i, (walk, b) in enumerate(zip(moving, bs)):
            k, ok = walk.places[step], False
            if i in held:
                jacobian, score = held[i]
                if np.isfinite(jacobian).all() and 1 / np.linalg.cond(jacobian) > 2.3e-16:
                    inverses[k] = np.linalg.inv(jacobian / n)
                    out[:, k], ok = b + inverses[k] @ (score / n), True
            if not ok:
                out[:, [k]], fell[k] = _globbed(blocks, taus[[k]], sample)[0], True
            walk.previous = k
    return Fit("qr", taus, out, info={"solver": "onestep", "exact": False, "converged": True, "fallbacks": fell, "inverses": inverses, "searches": [walk.quartiles.searches for walk in walks]})


QUARTILES = (0.25, 0.75)


def _joined(a, b):
    """Values and weights of two windows; many of them are joined where they are equal."""
    values, w = (np.concatenate(v) for v in zip(a, b))
    if len(values) > 2 * WINDOW_ROWS and len(a[0]) <= 2 * WINDOW_ROWS:
        values, _, w = _summed(values, np.zeros(len(values), np.int64), w)
    return values, w


class _Quartiles:
    """Exact quartiles of residuals along a sequence of fits, mostly by one pass for each.

    A sample tells how far they move from one fit to the next, much better than
    where they are; a pass collects what lies in narrow windows around those
    places. Ranks outside of them are left to a search of all residuals.
    """

    def __init__(self, sample, n: float, b: np.ndarray, first: np.ndarray):
        self.sample, self.n, self.searches = sample, n, 0
        self.guess, self.known = self._sampled(b)[1], np.asarray(first)

    def _sampled(self, b: np.ndarray):
        x, y, w = self.sample
        r = (y - x @ b) / w
        order = np.argsort(r, kind="stable")
        share = np.cumsum(w[order]) / w.sum()
        at = lambda q: r[order][np.minimum(np.searchsorted(share, q), len(r) - 1)]
        return at, at(QUARTILES)

    def windows(self, b: np.ndarray) -> list[tuple[float, float]]:
        at, guess = self._sampled(b)
        centre, self.guess = self.known + guess - self.guess, guess
        half = min(0.1, WINDOW_ROWS / (2 * self.n), 2 / np.sqrt(len(self.sample[2])))
        wide = (at(np.add(QUARTILES, half)) - at(np.subtract(QUARTILES, half))) / 2
        return list(zip(centre - wide, centre + wide))

    def found(self, held, below, total: float) -> np.ndarray | None:
        low, high, fraction = type7_positions(self.n, np.array(QUARTILES))
        out = []
        for (values, w), under, ranks, part in zip(held, below, zip(low, high), fraction):
            values, _, w = _summed(values, np.zeros(len(values), np.int64), w)
            running = (under + running_sum(w)).astype(float) * self.n / total
            ranks = np.array(ranks) - tolerance(self.n)
            if not len(values) or under * self.n / total >= ranks[0] or running[-1] < ranks[1]:
                return None
            a, b = values[np.searchsorted(running, ranks)]
            out.append((1 - part) * a + part * b)
        self.known = np.array(out)
        return out

    def learnt(self, values: np.ndarray) -> np.ndarray:
        self.known, self.searches = np.asarray(values), self.searches + 1
        return self.known


@dataclass
class _Walk:
    """The quantiles that lie to one side of the first fit, in order, and how far it got."""

    places: range
    previous: int
    quartiles: _Quartiles


def fit_weighted_qr(x, y, weights, taus, solver: str = "auto", precondition: bool = True, onestep_first_solver: str = "auto", onestep_bandwidth: str = "hall_sheather", frequency=None) -> Fit:
    """The process of one matrix in memory; ``frequency`` counts repeated rows."""
    freq = np.ones(len(y)) if frequency is None else np.asarray(frequency, float)
    w = np.asarray(weights, float)
    wf = w * freq
    blocks = LocalBlocks(x, y, wf / wf.mean() * (freq.sum() / len(freq)), freq)
    control = Control(qr_precondition=precondition, onestep_first_solver=onestep_first_solver, onestep_bandwidth=onestep_bandwidth)
    return fit_process(blocks, taus, solver, control)

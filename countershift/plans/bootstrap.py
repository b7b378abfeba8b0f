"""Bootstrap replications: one task each for data that fit a task, checkpoints that let runs resume and grow.

Small data (both groups within the kernel limit) are broadcast once and every
replication resamples, compresses repeated rows to frequencies, refits and
marginalises in its task. Data on executors are resampled where they lie: the
counts of a group split over buckets of its rows as one multinomial, then inside
each bucket as another, which together are the multinomial of the whole group.
Every random number comes from (seed, replication, attempt) and the rows'
content, never from a task or a partition; which of the two paths runs is part
of a run's signature.
"""

from __future__ import annotations

import hashlib
import json
import time
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from countershift import registry
from countershift.control import Control
from countershift.errors import DecompositionError
from countershift.functions.linalg import common_columns, triangular
from countershift.operators import qrkernel
from countershift.operators.blocks import Block, LocalBlocks, Replications, SparkBlocks
from countershift.operators.models import Fit
from countershift.operators.qr import fit_process
from countershift.plans import shared
from countershift.plans.decompose import Point, estimate_point, evaluate
from countershift.schemas import EFFECTS
from countershift.sources.prepare import content_hash
from countershift.sources.files import files_of, joined, write_atomic

#: Options that don't change a replication, so runs that differ in them share checkpoints.
FREE = ("alpha", "robust_se", "crossing_diagnostics", "crossing_tolerance", "bootstrap_progress", "weighted_bootstrap", "grid", "full_grid", "kernel_max_mb")


#: Replications of data on executors that run at a time.
SIDE_BY_SIDE = 4


@dataclass
class Bootstrap:
    draws: dict[str, np.ndarray]
    resources: list[dict]
    failures: list[dict]
    signature: str
    engine: str


def attempt_seed(seed: int, replication: int, attempt: int, stream: int = 0) -> int:
    return 1 + (seed + replication + 1_000_003 * attempt + 10_000_019 * stream - 1) % (2**31 - 2)


def multipliers(rng: np.random.Generator, n: int, scheme: str, freq: np.ndarray | None = None) -> np.ndarray:
    """Counts (resampling schemes) or exponential weights (multiplier) of ``n`` rows, or of rows that stand ``freq`` times."""
    if freq is not None and (freq != 1).any():
        # a row that stands m times has the sum of m exponential chances
        chance = freq if scheme == "empirical" else rng.gamma(freq)
        return chance if scheme == "multiplier" else rng.multinomial(int(freq.sum()), chance / chance.sum()).astype(float)
    if scheme == "multiplier":
        return rng.exponential(size=n)
    chance = rng.exponential(size=n) if scheme == "counterfactual" else np.ones(n)
    return rng.multinomial(n, chance / chance.sum()).astype(float)


def resolve_engine(model: str, solver: str | None, control: Control) -> str:
    engine = control.qr_bootstrap_engine
    if model != "qr":
        if engine not in ("standard", "auto"):
            raise DecompositionError(f"the {engine} engine is only for quantile regression")
        return "standard"
    if engine == "auto":
        return "onestep" if solver == "onestep" else "xy_preprocess" if solver in ("br", "fn", "pfn", "qfnb", "pfnb", "proqreg", "profn") else "standard"
    if engine == "onestep" and solver != "onestep":
        raise DecompositionError("the onestep engine needs the onestep solver")
    if engine == "xy_preprocess" and (solver in ("onestep", "cuda_admm") or solver in registry.solvers):
        raise DecompositionError("the xy_preprocess engine needs an exact built-in solver")
    return engine


def compress(block: Block, counts: np.ndarray, scheme: str) -> LocalBlocks:
    """Rows drawn at least once, with weights w * count and their counts as frequencies."""
    keep = np.flatnonzero(counts > 0)
    b = Block(*(v[keep] for v in block))
    return LocalBlocks(b.x, b.y, b.w / b.freq * counts[keep], b.freq if scheme == "multiplier" else counts[keep], b.cens, b.event)


def replicate(groups, point: Point, model, solver, control: Control, engine: str, seed: int, replication: int, attempt: int) -> dict[str, np.ndarray]:
    """Effects of one replication of groups in memory."""
    rng = np.random.default_rng(attempt_seed(seed, replication, attempt))
    scheme = control.bootstrap_scheme
    counts = [multipliers(rng, g.rows, scheme, g.block.freq) for g in groups]
    drawn = tuple(compress(g.block, c, scheme) for g, c in zip(groups, counts))
    if engine == "standard":
        factors = []
        for g in drawn:
            scale = np.abs(g.block.x).max(axis=0, initial=0.0)
            factors.append(triangular(g.block.x / np.where(scale > 0, scale, 1)))
        keep = common_columns(*factors)
        if len(keep) < groups[0].p:
            drawn = tuple(LocalBlocks(g.block.x[:, keep], *g.block[1:]) for g in drawn)
        return estimate_point(drawn, model, solver, control, with_observed=False).effects
    refit = _xy if engine == "xy_preprocess" else _onestep
    fits = tuple(refit(g, fit) for g, fit in zip(drawn, point.fits))
    return evaluate(drawn, fits, model, control, with_observed=False)[0]


def _xy(blocks: LocalBlocks, fit: Fit) -> Fit:
    """Exact refits that start from the point estimate: rows far from its fit become two rows, signs are checked."""
    b = blocks.block
    x, y = b.x * b.w[:, None], b.y * b.w
    n, p = x.shape
    out = np.empty_like(fit.coefficients)
    r = np.linalg.qr(x, mode="r")
    leverage = np.sqrt(np.maximum(((np.linalg.solve(r.T, x.T)) ** 2).sum(axis=0), 1e-12))
    for k, tau in enumerate(fit.grid):
        size, found = min(n, int(np.ceil(3 * np.sqrt(p) * n ** (2 / 3)))), None
        standard = (y - x @ fit.coefficients[:, k]) / leverage
        start = fit.coefficients[:, k]
        for _ in range(25):
            if size >= n:
                break
            near = np.argpartition(np.abs(standard), size - 1)[:size]
            band = np.zeros(n, bool)
            band[near] = True
            low, high = ~band & (standard < 0), ~band & (standard >= 0)
            for _ in range(10):
                xs = np.vstack([x[band], x[low].sum(axis=0), x[high].sum(axis=0)])
                ys = np.concatenate([y[band], [y[low].sum(), y[high].sum()]])
                used = np.concatenate([np.ones(band.sum(), bool), [low.any(), high.any()]])
                now, ok, _ = qrkernel.exact(xs[used], ys[used], tau, start)
                residual = y - x @ now
                wrong = (low & (residual > 0)) | (high & (residual < 0))
                if not ok or wrong.sum() > 0.1 * size:
                    break
                if not wrong.any():
                    found = now
                    break
                band |= wrong
                low, high = low & ~wrong, high & ~wrong
            if found is not None:
                break
            size *= 2
        out[:, k] = found if found is not None else qrkernel.exact(x, y, tau, start)[0]
    return Fit("qr", fit.grid, out, info={"solver": "xy_preprocess"})


def _onestep(blocks: LocalBlocks, fit: Fit) -> Fit:
    """One Newton step per quantile with the point estimate's inverse Jacobians and this replication's scores."""
    b = blocks.block
    total, out = b.w.sum(), np.empty_like(fit.coefficients)
    start = int(np.argmin(np.abs(np.asarray(fit.grid) - 0.5)))
    x, y = b.x * b.w[:, None], b.y * b.w
    out[:, start] = qrkernel.exact(x, y, fit.grid[start], fit.coefficients[:, start])[0]
    inverses = fit.info["inverses"]
    for sequence in (range(start + 1, len(fit.grid)), range(start - 1, -1, -1)):
        previous = start
        for k in sequence:
            if k in inverses:
                score = (b.w * (fit.grid[k] - qrkernel.reached(b.y, b.x @ out[:, previous]))) @ b.x / total
                out[:, k] = out[:, previous] + inverses[k] @ score
            else:
                out[:, k] = qrkernel.exact(x, y, fit.grid[k], out[:, previous])[0]
            previous = k
    return Fit("qr", fit.grid, out, info={"solver": "onestep"})


# ---- rows on executors -----------------------------------------------------------------------


#: Distinct rows of a bucket, about; a task holds one at a time.
BUCKET_ROWS = 50_000
#: Rows that a task sends on together where they carry the multipliers of many replications.
SLICE = 2_000


class StableRows:
    """A group's distinct rows in buckets by their content, from which resamples are drawn where the rows lie.

    Equal rows are one with a count, so rows that repeat often weigh nothing; a
    bucket's random numbers come from (seed, group, bucket) in the order of the
    rows' content. So neither partitions nor tasks change a draw.
    """

    def __init__(self, blocks: SparkBlocks, group: int):
        self.blocks, self.group = blocks, group
        keys = [n for n in blocks.names if n != "freq"]
        # zeros of either sign are one content
        one = {"w": F.col("w") / F.col("freq")}  # the weight that each of the equal rows has
        rows = blocks.frame.select(*[(one.get(n, F.col(n)) + F.lit(0.0)).alias(n) for n in keys], "freq").groupBy(*keys).agg(F.sum("freq").alias("freq"))
        self.buckets = max(8, -(-blocks.rows // BUCKET_ROWS))
        placed = rows.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        self.frame = placed.repartition(min(self.buckets, 4096), "bucket_").sortWithinPartitions("bucket_", *keys).select("bucket_", *blocks.names).persist()

    def release(self) -> None:
        self.frame.unpersist()

    def _buckets(self):
        """A function from a task's batches to its buckets and their rows."""
        names = self.blocks.names

        def buckets(batches):
            held, now = [], None
            for batch in batches:
                numbers = batch.column(0).to_numpy()
                columns = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns[1:]]) if len(numbers) else np.empty((0, len(names)))
                for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                    if not len(part):
                        continue
                    if numbers[part[0]] != now:
                        if held:
                            yield now, np.concatenate(held)
                        held, now = [], int(numbers[part[0]])
                    held.append(columns[part])
            if held:
                yield now, np.concatenate(held)

        return buckets

    def drawn(self, scheme: str, seeds: list[int]):
        """A function from a bucket and its rows to the multipliers (rows x seeds) of the resamples of these seeds.

        One pass sums the chances of each bucket for all seeds; each resample is
        a multinomial over buckets, then inside each.
        """
        buckets, group, at = self._buckets(), self.group, self.blocks.names.index("freq")

        def chance(bucket: int, rows: np.ndarray, seed: int) -> np.ndarray:
            # a row that stands m times has the sum of m exponential chances
            return rows[:, at] if scheme == "empirical" else np.random.default_rng([seed, group, bucket]).gamma(rows[:, at])

        if scheme == "multiplier":
            return lambda bucket, rows: np.column_stack([chance(bucket, rows, s) for s in seeds])

        def totals(batches):
            for bucket, rows in buckets(batches):
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([[float(chance(bucket, rows, s).sum()) for s in seeds]], pa.list_(pa.float64()))], names=["bucket", "total"])

        parts = sorted((r["bucket"], r["total"]) for r in self.frame.mapInArrow(totals, "bucket int, total array<double>").collect())
        weights = np.array([t for _, t in parts])
        split = np.column_stack([np.random.default_rng([s, group, 2**20]).multinomial(int(self.blocks.total), weights[:, k] / weights[:, k].sum()) for k, s in enumerate(seeds)])
        shares = {bucket: split[k] for k, (bucket, _) in enumerate(parts)}

        def counts(bucket: int, rows: np.ndarray) -> np.ndarray:
            out = np.empty((len(rows), len(seeds)))
            for k, s in enumerate(seeds):
                own = chance(bucket, rows, s)
                out[:, k] = np.random.default_rng([s, group, bucket, 1]).multinomial(shares[bucket][k], own / own.sum())
            return out

        return counts

    def resample(self, scheme: str, seed: int) -> SparkBlocks:
        """A resample, compressed; exact in law for the whole group."""
        names, buckets, multiplied = self.blocks.names, self._buckets(), self.drawn(scheme, [seed])

        def draw(batches):
            for bucket, rows in buckets(batches):
                counts = multiplied(bucket, rows)[:, 0]
                keep = np.flatnonzero(counts > 0)
                columns = {n: rows[keep, k] for k, n in enumerate(names)}
                columns["w"] = columns["w"] * counts[keep]
                if scheme != "multiplier":  # there all rows stay, as often as they stand
                    columns["freq"] = counts[keep]
                yield pa.record_batch([pa.array(columns[n]) for n in names], names=names)

        out = self.frame.mapInArrow(draw, ", ".join(f"{n} double" for n in names)).persist()
        rows, total = out.agg(F.count("*"), F.sum("freq")).first()
        return SparkBlocks(out, self.blocks.width, rows, float(total), self.blocks.transform)

    def replicated(self, scheme: str, seeds: list[int]) -> Replications:
        """All resamples of these seeds at once: each row with its multiplier in every one of them."""
        names, buckets, multiplied = self.blocks.names, self._buckets(), self.drawn(scheme, seeds)
        kept, kind = [n for n in names if n != "freq"], np.float64 if scheme == "multiplier" else np.int32

        def draw(batches):
            for bucket, rows in buckets(batches):
                for at in range(0, len(rows), SLICE):
                    # draws go by whole buckets; they are sent in slices
                    if not at:
                        m = multiplied(bucket, rows)
                    part = m[at : at + SLICE].astype(kind)
                    keep = np.flatnonzero((part > 0).any(axis=1))
                    columns = {n: rows[at + keep, k] for k, n in enumerate(names)}
                    held = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.arange(0, (len(keep) + 1) * part.itemsize * len(seeds), part.itemsize * len(seeds), dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(part[keep]))])
                    yield pa.record_batch([*(pa.array(columns[n]) for n in kept), held], names=[*kept, "m_"])

        out = self.frame.mapInArrow(draw, ", ".join(f"{n} double" for n in kept) + ", m_ binary").persist()
        return Replications(out, self.blocks.width, out.count(), float(self.blocks.total), self.blocks.transform, len(seeds), kind)


def resample_frame(blocks: SparkBlocks, scheme: str, seed: int, group: int) -> SparkBlocks:
    """One resample of a group on executors."""
    rows = StableRows(blocks, group)
    try:
        return rows.resample(scheme, seed)
    finally:
        rows.release()


def _full_rank(drawn: tuple) -> tuple:
    """Columns that a resample makes collinear go, as they do for groups in memory."""
    factors = []
    for g in drawn:
        largest = g.reduce(lambda b: np.abs(b.x).max(axis=0, initial=0.0), np.maximum)
        scale = np.where(largest > 0, largest, 1.0)
        factors.append(g.reduce(lambda b, s=scale: triangular(b.x / s), lambda a, b: triangular(np.vstack([a, b]))))
    keep = common_columns(*factors)
    return drawn if len(keep) == drawn[0].p else tuple(g.design(np.eye(g.p)[:, keep]) for g in drawn)


def _onestep_passes(blocks, fit: Fit, control: Control) -> Fit:
    """As :func:`_onestep`, with scores summed where the rows lie: a pass moves one quantile up and one down from the middle."""
    taus, out = np.asarray(fit.grid), np.empty_like(fit.coefficients)
    start = int(np.argmin(np.abs(taus - 0.5)))
    total, inverses = blocks.reduce(lambda b: b.w.sum()), fit.info["inverses"]
    exact = lambda k: fit_process(blocks, [taus[k]], "pfn", control).coefficients[:, 0]
    out[:, start] = exact(start)
    for distance in range(1, len(taus)):
        sides = [(k, k - s) for k, s in ((start + distance, 1), (start - distance, -1)) if 0 <= k < len(taus)]
        fast = [(k, before) for k, before in sides if k in inverses]
        if fast:
            previous, level = out[:, [before for _, before in fast]], taus[[k for k, _ in fast]]
            scores = blocks.reduce(lambda b, c=previous, t=level: b.x.T @ (b.w[:, None] * (t - qrkernel.reached(b.y[:, None], b.x @ c)))) / total
            for (k, before), score in zip(fast, scores.T):
                out[:, k] = out[:, before] + inverses[k] @ score
        for k, _ in sides:
            if k not in inverses:
                out[:, k] = exact(k)
    return Fit("qr", fit.grid, out, info={"solver": "onestep"})


# ---- the loop --------------------------------------------------------------------------------


def signature(prepared, model, solver, control: Control, engine: str, seed: int, formula: str) -> str:
    """Names what decides a replication's numbers: data, model, settings, seed, active extensions."""
    content = []
    for g in prepared.groups:
        def digest(b: Block) -> np.ndarray:
            h = content_hash([*b.x.T, b.y, b.w, b.cens, b.event, *([b.freq] if (b.freq != 1).any() else [])])
            return np.array([h.sum(dtype=np.uint64), len(h)], np.uint64)

        content.append(g.reduce(digest).tolist())
    settings = {f.name: getattr(control, f.name) for f in fields(control) if f.name not in FREE}
    path = "memory" if all(isinstance(g, LocalBlocks) for g in prepared.groups) else "executors"
    identity = [path, content, prepared.columns, model, solver, engine, seed, formula, settings, registry.active_fingerprint(solver or "", control.linear_backend, control.dr_backend), np.__version__, 2]
    return hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()[:32]


def _valid(path: str, name: str, replication: int, k: int) -> dict | None:
    """A checkpoint's content if every field is as it must be."""
    try:
        data = json.loads(files_of(path).read(path))
        ok = data["signature"] == name and data["replication"] == replication and all(len(data["effects"][e]) == k for e in EFFECTS)
        finite = all(v is None or np.isfinite(v) for e in EFFECTS for v in data["effects"][e])
        return data if ok and finite and data["elapsed_sec"] >= 0 and isinstance(data["failures"], list) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def run_bootstrap(prepared, point: Point, model, solver, control: Control, reps: int, checkpoint_dir, seed: int, spark: SparkSession, formula: str) -> Bootstrap:
    engine = resolve_engine(model, solver, control)
    name = signature(prepared, model, solver, control, engine, seed, formula)
    k = len(control.reported_quantiles)
    done: dict[int, dict] = {}
    folder = None
    if checkpoint_dir:
        folder = joined(checkpoint_dir, f"run_{name}")
        files_of(folder).make_folder(folder)
        for r in range(1, reps + 1):
            found = _valid(joined(folder, f"rep_{r:06d}.json"), name, r, k)
            if found:
                done[r] = found
    missing = [r for r in range(1, reps + 1) if r not in done]
    run = _run_small if all(isinstance(g, LocalBlocks) for g in prepared.groups) else _run_large
    for result in run(prepared.groups, point, model, solver, control, engine, seed, missing, spark):
        result["signature"] = name
        if result["effects"] is not None:
            done[result["replication"]] = result
            if folder:
                write_atomic(joined(folder, f"rep_{result['replication']:06d}.json"), json.dumps(result))
        else:
            done.setdefault(-result["replication"], result)
    failures = [f for r in done.values() for f in r["failures"]]
    lost = sorted(-r for r in done if r < 0)
    if lost:
        if folder:
            write_atomic(joined(folder, "bootstrap_failures.csv"), pd.DataFrame(failures).to_csv(index=False))
        raise DecompositionError(f"replications {lost[:5]} failed in every attempt: {failures[-1]['message']}")
    order = [done[r] for r in range(1, reps + 1)]
    draws = {e: np.array([[np.nan if v is None else v for v in d["effects"][e]] for d in order], float).reshape(reps, k) for e in EFFECTS}
    resources = [{"replication": d["replication"], "elapsed_sec": d["elapsed_sec"], "attempts": d["attempts"]} for d in order]
    return Bootstrap(draws, resources, failures, name, engine)


def _attempts(one, replication: int, retries: int) -> dict:
    """Run ``one(attempt)`` until it succeeds; failures are rows, not exceptions."""
    failures, began = [], time.perf_counter()
    for attempt in range(retries + 1):
        try:
            effects = one(attempt)
            plain = {e: [None if not np.isfinite(v) else float(v) for v in effects[e]] for e in EFFECTS}
            return {"replication": replication, "effects": plain, "failures": failures, "attempts": attempt + 1, "elapsed_sec": time.perf_counter() - began}
        except (DecompositionError, np.linalg.LinAlgError, FloatingPointError) as e:
            failures.append({"replication": replication, "attempt": attempt, "message": str(e)[:500]})
    return {"replication": replication, "effects": None, "failures": failures, "attempts": retries + 1, "elapsed_sec": time.perf_counter() - began}


def _run_small(groups, point, model, solver, control, engine, seed, missing, spark):
    if not missing:
        return
    state = spark.sparkContext.broadcast(([g.block for g in groups], point, registry.snapshot()))
    retries = control.bootstrap_max_retries

    def work(frames):
        blocks, own_point, extensions = state.value
        registry.restore(extensions)
        held = tuple(LocalBlocks(*b) for b in blocks)
        for frame in frames:
            out = [json.dumps(_attempts(lambda a, r=r: replicate(held, own_point, model, solver, control, engine, seed, r, a), int(r), retries)) for r in frame["r"]]
            yield pd.DataFrame({"result": out})

    tasks = min(len(missing), 4 * spark.sparkContext.defaultParallelism)
    ids = spark.createDataFrame([(r,) for r in missing], "r int").repartition(tasks)
    for row in ids.mapInPandas(work, "result string").toLocalIterator():
        yield json.loads(row["result"])
    state.unpersist()


def _shared(rows, point: Point, engine: str, control: Control, seed: int, missing: list[int], one):
    """Replications whose first attempts share passes; those that shared passes can't fit are tried one by one."""
    began = time.perf_counter()
    groups = tuple(x.replicated(control.bootstrap_scheme, [attempt_seed(seed, r, 0) for r in missing]) for x in rows)
    try:
        found, good, _ = shared.effects(groups, point, engine, control)
    finally:
        for g in groups:
            g.frame.unpersist()
    each = (time.perf_counter() - began) / len(missing)
    for k, r in enumerate(missing):
        if good[k]:
            plain = {e: [None if not np.isfinite(v) else float(v) for v in found[e][k]] for e in EFFECTS}
            yield {"replication": r, "effects": plain, "failures": [], "attempts": 1, "elapsed_sec": each}
        else:
            yield one(r)


def _run_large(groups, point, model, solver, control, engine, seed, missing, spark):
    """Replications of groups on executors: quantile regressions and location models share every pass, other models run ``SIDE_BY_SIDE``.

    The exact engines are one here: refits keep rows near the point estimate and
    sum the others.
    """
    if not missing:
        return
    rows = [StableRows(b, g) for g, b in enumerate(groups)]

    def one(r: int) -> dict:
        def attempt(number: int):
            s = attempt_seed(seed, r, number)
            drawn = tuple(x.resample(control.bootstrap_scheme, s) for x in rows)
            try:
                if engine == "onestep":
                    fits = tuple(_onestep_passes(b, fit, control) for b, fit in zip(drawn, point.fits))
                    return evaluate(drawn, fits, model, control, with_observed=False)[0]
                own = estimate_point(_full_rank(drawn), model, solver, control, with_observed=False)
                for fit in own.fits:
                    fit.release()
                return own.effects
            finally:
                for d in drawn:
                    d.frame.unpersist()

        return _attempts(attempt, r, control.bootstrap_max_retries)

    try:
        if shared.supports(model, solver, control, groups):
            for at in range(0, len(missing), shared.TOGETHER):
                yield from _shared(rows, point, engine, control, seed, missing[at : at + shared.TOGETHER], one)
            return
        with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(missing))) as pool:
            yield from (f.result() for f in as_completed([pool.submit(one, r) for r in missing]))
    finally:
        for x in rows:
            x.release()

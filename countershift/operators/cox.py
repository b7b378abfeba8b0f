"""Weighted Cox regression with Breslow ties, its baseline, and Kaplan-Meier quantiles.

Rows are ordered by time once; every Newton step needs sums over rows at risk.
In memory these are reversed cumulative sums. On executors the rows lie in time
ranges: one pass brings each range's totals, the driver carries them from later
to earlier ranges, a second pass completes the sums inside the ranges. No step
brings rows to the driver; the baseline is a table of event times there, and
what is asked of it are aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.control import Control
from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.functions.ranks import EPS
from countershift.operators.blocks import Blocks, LocalBlocks, SparkBlocks
from countershift.operators.frame import range_of, running_sums
from countershift.operators.models import Fit

MAXIT = 50
MAX_EVENT_TIMES = 20_000_000


def _by_time(y, event, w, x, b, shift):
    """Rows in descending time: distinct times with event weight, risk sums and moments."""
    eta = x @ b
    risk = w * np.exp(eta - shift)
    times, first = np.unique(-y, return_index=True)
    return -times, np.append(first, len(y)), eta, risk


def _step(y, event, w, x, b, shift, carry, with_moments=True):
    """Log likelihood, score and information of sorted rows (descending time), with sums of later rows carried in."""
    p = x.shape[1]
    _, first, eta, risk = _by_time(y, event, w, x, b, shift)
    ends = first[1:] - 1
    s0 = np.cumsum(risk)[ends] + carry[0]
    s1 = np.cumsum(risk[:, None] * x, axis=0)[ends] + carry[1]
    dead = event * w
    d = np.add.reduceat(dead, first[:-1])
    has = d > 0
    likelihood = float(dead @ (eta - shift) - d[has] @ np.log(s0[has]))
    mean = s1[has] / s0[has, None]
    score = dead @ x - d[has] @ mean
    iu = np.triu_indices(p)
    pairs = x[:, iu[0]] * x[:, iu[1]]
    s2 = np.cumsum(risk[:, None] * pairs, axis=0)[ends] + carry[2]
    info_flat = (d[has] / s0[has]) @ s2[has] - d[has] @ (mean[:, iu[0]] * mean[:, iu[1]])
    info = np.zeros((p, p))
    info[iu] = info_flat
    return likelihood, score, info + np.triu(info, 1).T


def _zero(p: int):
    return 0.0, np.zeros(p), np.zeros(p * (p + 1) // 2)


class HazardArrays:
    """A baseline in memory: event times and cumulative hazards, both ascending."""

    def __init__(self, times: np.ndarray, hazard: np.ndarray):
        self.times, self.hazard = np.asarray(times, float), np.asarray(hazard, float)

    def ends(self) -> tuple[float, float]:
        """The last event time and hazard."""
        return float(self.times[-1]), float(self.hazard[-1])

    def between(self, spans: list[tuple[float, float]], most: int) -> list[list[float]]:
        """For each open span hazards strictly inside it: all, or ``most`` that divide them about equally."""
        out = []
        for lo, hi in spans:
            a, b = int(np.searchsorted(self.hazard, lo, side="right")), int(np.searchsorted(self.hazard, hi))
            out.append(self.hazard[np.unique(np.linspace(a, b - 1, min(most, b - a)).astype(int))].tolist() if b > a else [])
        return out

    def first(self, hazards: list[float]) -> list[float]:
        """The first event time with each hazard or more."""
        return self.times[np.searchsorted(self.hazard, hazards)].tolist()

    def release(self) -> None:
        pass


class HazardTable:
    """The same as a DataFrame (time, hazard), as many rows as there are event times: every question is one aggregate, and only answers reach the driver."""

    def __init__(self, table: DataFrame, kept: list[DataFrame] | None = None):
        self.table, self.kept = table.persist(), kept or []

    def ends(self) -> tuple[float, float]:
        r = self.table.agg(F.max("time").alias("time"), F.max("hazard").alias("hazard")).first()
        return r["time"], r["hazard"]

    def between(self, spans: list[tuple[float, float]], most: int) -> list[list[float]]:
        inside = [F.when((F.col("hazard") > lo) & (F.col("hazard") < hi), F.col("hazard")) for lo, hi in spans]
        shares = F.array(*[F.lit((k + 0.5) / most) for k in range(most)])
        # the least and the greatest are exact, so that a span of few hazards shrinks to none
        asked = [F.array_union(F.coalesce(F.percentile_approx(c, shares, F.lit(1000)), F.array().cast("array<double>")), F.array_compact(F.array(F.min(c), F.max(c)))).alias(f"s{i}") for i, c in enumerate(inside)]
        r = self.table.agg(*asked).first()
        return [sorted(set(r[f"s{i}"])) for i in range(len(spans))]

    def first(self, hazards: list[float]) -> list[float]:
        r = self.table.agg(*[F.min(F.when(F.col("hazard") >= float(h), F.col("time"))).alias(f"t{i}") for i, h in enumerate(hazards)]).first()
        return [r[f"t{i}"] for i in range(len(hazards))]

    def release(self) -> None:
        for df in (self.table, *self.kept):
            df.unpersist()

    def __reduce__(self):
        """Where a fit is stored its baseline becomes arrays, up to a checked number of times."""
        if self.table.count() > MAX_EVENT_TIMES:
            raise DecompositionError("too many distinct event times to store a baseline")
        got = self.table.orderBy("time").toArrow()
        return HazardArrays, (got.column("time").to_numpy(), got.column("hazard").to_numpy())


class _Local:
    def __init__(self, blocks: LocalBlocks, columns: list[int]):
        b = blocks.block
        order = np.argsort(-b.y, kind="stable")
        self.y, self.event, self.w, self.x = b.y[order], b.event[order], b.w[order], b.x[order][:, columns]

    def largest(self, b) -> float:
        return float((self.x @ b).max())

    def step(self, b, shift):
        return _step(self.y, self.event, self.w, self.x, b, shift, _zero(self.x.shape[1]))

    def baseline(self, b, shift):
        times, first, _, risk = _by_time(self.y, self.event, self.w, self.x, b, shift)
        d = np.add.reduceat(self.event * self.w, first[:-1])
        s0 = np.cumsum(risk)[first[1:] - 1]
        has = d > 0
        return HazardArrays(times[has][::-1], np.cumsum((d[has] / s0[has])[::-1]))


class _Ranges:
    """Rows on executors in ranges of descending time."""

    def __init__(self, blocks: SparkBlocks, columns: list[int]):
        self.build, self.columns, self.p = blocks._block(), columns, len(columns)
        parts = max(2, blocks.frame.rdd.getNumPartitions())
        self.frame = blocks.frame.select(*blocks.names).repartitionByRange(parts, F.col("y").desc()).sortWithinPartitions(F.col("y").desc()).persist()

    def _run(self, fn, schema: pa.Schema, ddl: str):
        build, columns = self.build, self.columns

        def run(batches):
            blocks = [build(b) for b in batches if b.num_rows]
            if blocks:
                y, w, event = (np.concatenate([getattr(b, k) for b in blocks]) for k in ("y", "w", "event"))
                x = np.concatenate([b.x for b in blocks])[:, columns]
                yield pa.RecordBatch.from_pylist(fn(TaskContext.get().partitionId(), y, event, w, x), schema=schema)

        return self.frame.mapInArrow(run, ddl).collect()

    def largest(self, b) -> float:
        rows = self._run(lambda k, y, e, w, x: [{"k": k, "v": [float((x @ b).max())]}], _VECTOR, _VECTOR_DDL)
        return max(r["v"][0] for r in rows)

    def _carries(self, b, shift):
        iu = np.triu_indices(self.p)

        def totals(k, y, e, w, x):
            risk = w * np.exp(x @ b - shift)
            return [{"k": k, "v": [float(risk.sum()), *(risk @ x).tolist(), *(risk @ (x[:, iu[0]] * x[:, iu[1]])).tolist()]}]

        out, now = {}, np.zeros(1 + self.p + len(iu[0]))
        for r in sorted(self._run(totals, _VECTOR, _VECTOR_DDL), key=lambda r: r["k"]):
            out[r["k"]] = now.copy()
            now = now + np.array(r["v"])
        return out

    def step(self, b, shift):
        carries, p = self._carries(b, shift), self.p

        def run(k, y, e, w, x):
            c = carries[k]
            likelihood, score, info = _step(y, e, w, x, b, shift, (c[0], c[1 : 1 + p], c[1 + p :]))
            return [{"k": k, "v": [likelihood, *score.tolist(), *info.ravel().tolist()]}]

        total = np.sum([r["v"] for r in sorted(self._run(run, _VECTOR, _VECTOR_DDL), key=lambda r: r["k"])], axis=0)
        return float(total[0]), total[1 : 1 + p], total[1 + p :].reshape(p, p)

    def baseline(self, b, shift) -> HazardTable:
        """One row per distinct event time: running sums inside the ranges, then those of earlier ranges, of which the driver adds one number each."""
        build, columns, carries = self.build, self.columns, self._carries(b, shift)

        def run(batches):
            blocks = [build(k) for k in batches if k.num_rows]
            if blocks:
                y, w, e = (np.concatenate([getattr(k, name) for k in blocks]) for name in ("y", "w", "event"))
                x, part = np.concatenate([k.x for k in blocks])[:, columns], TaskContext.get().partitionId()
                times, first, _, risk = _by_time(y, e, w, x, b, shift)
                d = np.add.reduceat(e * w, first[:-1])
                has = d > 0
                steps = (d / (np.cumsum(risk)[first[1:] - 1] + carries[part][0]))[has][::-1]
                yield pa.record_batch([pa.array(np.full(len(steps), part), pa.int32()), pa.array(times[has][::-1]), pa.array(np.cumsum(steps))], names=["range_", "time", "own"])

        own = self.frame.mapInArrow(run, "range_ int, time double, own double").persist()
        # ranges descend in time, so those of greater numbers come before
        totals = sorted(((r["range_"], r["total"]) for r in own.groupBy("range_").agg(F.max("own").alias("total")).collect()), reverse=True)
        before = np.cumsum([0.0, *(t for _, t in totals)])
        carry = own.sparkSession.createDataFrame([(k, float(v)) for (k, _), v in zip(totals, before)] or [(-1, 0.0)], "range_ int, carry double")
        return HazardTable(own.join(F.broadcast(carry), "range_").select("time", (F.col("own") + F.col("carry")).alias("hazard")), [own])


_VECTOR = pa.schema([("k", pa.int32()), ("v", pa.list_(pa.float64()))])
_VECTOR_DDL = "k int, v array<double>"


def fit_cox(blocks: Blocks, control: Control, intercept: int = 0) -> Fit:
    columns = [j for j in range(blocks.p) if j != intercept]
    if not columns:
        raise NotIdentifiedError("the cox model needs a covariate")
    low, events = blocks.reduce(lambda b: (np.array([b.y.min(initial=np.inf)]), np.array([b.event.sum()])), lambda a, b: (np.minimum(a[0], b[0]), a[1] + b[1]))
    if low[0] < 0:
        raise DecompositionError("durations must not be negative")
    if not events[0]:
        raise NotIdentifiedError("the cox model needs an event")
    rows = _Local(blocks, columns) if isinstance(blocks, LocalBlocks) else _Ranges(blocks, columns)
    b = np.zeros(len(columns))
    value, score, info = rows.step(b, 0.0)
    converged = False
    for _ in range(MAXIT):
        try:
            change = np.linalg.solve(info, score)
        except np.linalg.LinAlgError:
            raise NotIdentifiedError("the cox model's information is singular") from None
        for _ in range(20):
            candidate = b + change
            shift = rows.largest(candidate)
            following = rows.step(candidate, shift)
            if following[0] >= value - 1e-10 * (1 + abs(value)):
                break
            change = change / 2
        done = abs(following[0] - value) <= 1e-12 * (1 + abs(value)) and np.abs(change).max() <= 1e-9 * (1 + np.abs(candidate).max())
        b, (value, score, info) = candidate, following
        if done:
            converged = True
            break
    if not converged or not np.isfinite(b).all():
        raise NotIdentifiedError("the cox model did not converge")
    shift = rows.largest(b)
    baseline = rows.baseline(b, shift)
    full = np.zeros((blocks.p, 1))
    full[columns, 0] = b
    return Fit("cox", np.empty(0), full, baseline=baseline, shift=shift, info={"log_likelihood": value})


def cox_quantiles(fit: Fit, blocks: Blocks, probs, boundary: str) -> tuple[np.ndarray, int, float]:
    """First event time at which the mean of 1 - exp(-H(t) risk) reaches each probability: a search over hazards.

    That mean depends on the time by its hazard alone. One pass evaluates up to
    18 hazards between the bounds of each open probability, so few passes do;
    the baseline answers which hazards and which time, wherever it lies.
    """
    b, shift, baseline = fit.coefficients[:, 0], fit.shift, fit.baseline
    known: dict[float, float] = {}

    def evaluate(hazards) -> None:
        h = np.array(sorted(set(hazards) - set(known)))
        if len(h):

            def sums(k):
                risk = np.exp(np.minimum(700, k.x @ b - shift))
                return (k.w[:, None] * -np.expm1(-h[None, :] * risk[:, None])).sum(axis=0), np.array([k.w.sum()])

            values, weight = blocks.reduce(sums)
            known.update(zip(h.tolist(), values / weight[0]))

    probs = np.asarray(probs, float)
    last, top = baseline.ends()
    evaluate([top])
    spans = {i: (0.0, top) for i, p in enumerate(probs) if p <= known[top] + 64 * EPS}
    open_ = list(spans)
    while open_:
        between = dict(zip(open_, baseline.between([spans[i] for i in open_], 16)))
        open_ = [i for i in open_ if between[i]]
        evaluate(h for i in open_ for h in between[i])
        for i in open_:
            lo, hi = spans[i]
            for h in between[i]:
                if known[h] >= probs[i] - 64 * EPS:
                    hi = h
                    break
                lo = h
            spans[i] = (lo, hi)
    out = np.full(len(probs), np.nan)
    if spans:
        out[list(spans)] = baseline.first([hi for _, hi in spans.values()])
    return _bounded(out, probs, float(known[top]), last, boundary)


def _bounded(out, probs, top: float, last_time: float, boundary: str):
    missing = np.isnan(out)
    if missing.any() and boundary == "error":
        raise NotIdentifiedError(f"quantiles {np.asarray(probs)[missing].tolist()} lie above the identified distribution ({top:.4g})")
    if boundary == "cap":
        out = np.where(missing, last_time, out)
    return out, int(missing.sum()), top


def kaplan_meier(frame: DataFrame, time: str, event: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weighted Kaplan-Meier by DataFrame operations: time, d, r, cdf per distinct time (and group).

    Rows are summed by time before any window, so a window sees distinct times.
    """
    keys = by or []
    at = frame.groupBy(*keys, F.col(time).alias("time")).agg(F.sum(F.col(weight) * F.col(event)).alias("d"), F.sum(weight).alias("w")).persist()
    at = at.withColumn("range_", range_of(at, "time"))
    risk = running_sums(at, "time", {"r": F.col("w")}, keys, descending=True)
    step = F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("r"))
    # a zero factor ends the product; logarithms carry the others
    parts = {"ended": (step <= 0).cast("double"), "logs": F.when(step > 0, F.ln(step)).otherwise(0.0)}
    product = running_sums(risk, "time", parts, keys)
    return product.select(*keys, "time", "d", "r", F.when(F.col("ended") > 0, 1.0).otherwise(1 - F.exp("logs")).alias("cdf"))


def km_quantiles(y, event, weights, probs, boundary: str = "na") -> np.ndarray:
    """The same of arrays in memory: first time with cdf >= p - 64 eps."""
    times, back = np.unique(np.asarray(y, float), return_inverse=True)
    w = np.asarray(weights, float)
    d, all_w = np.bincount(back, w * np.asarray(event, float)), np.bincount(back, w)
    r = np.cumsum(all_w[::-1])[::-1]
    cdf = 1 - np.cumprod(np.maximum(0, 1 - d / r))
    probs = np.asarray(probs, float)
    reaches = cdf[None, :] >= probs[:, None] - 64 * EPS
    out = np.where(reaches.any(axis=1), times[reaches.argmax(axis=1)], np.nan)
    last = times[d > 0][-1] if (d > 0).any() else times[-1]
    return _bounded(out, probs, float(cdf[-1]), last, boundary)[0]


def km_blocks(blocks: Blocks, probs, boundary: str) -> np.ndarray:
    """Kaplan-Meier quantiles of a group. On executors the running product goes by ranges of times, and the driver sees the quantiles alone."""
    if isinstance(blocks, LocalBlocks):
        b = blocks.block
        return km_quantiles(b.y, b.event, b.w, probs, boundary)
    table = kaplan_meier(blocks.frame, "y", "event", "w")
    asked = [F.min(F.when(F.col("cdf") >= float(p) - 64 * EPS, F.col("time"))).alias(f"q{i}") for i, p in enumerate(probs)]
    r = table.agg(F.max("cdf").alias("top"), F.max(F.when(F.col("d") > 0, F.col("time"))).alias("last"), F.max("time").alias("end"), *asked).first()
    out = np.array([np.nan if r[f"q{i}"] is None else r[f"q{i}"] for i in range(len(probs))])
    return _bounded(out, probs, float(r["top"]), r["end"] if r["last"] is None else r["last"], boundary)[0]

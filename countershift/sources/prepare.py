"""From any table to two groups of design rows.

One projection (formula, group, weights, ...), one complete-case filter (nulls,
NaN and infinities alike), one aggregate for counts, checks, mean weight and the
columns' ranges; then the largest set of columns that is independent in both
groups, from R factors that blocks reduce to. Weights are divided by their mean
over both groups before the split.

Where asked to, rows that are equal in all that a model sees become one row with
a frequency, whose weight is that of all of them; the fits and quantiles of such
rows are those of the rows themselves.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countershift.errors import DecompositionError, NotIdentifiedError
from countershift.functions.linalg import common_columns, triangular
from countershift.operators.blocks import Blocks, LocalBlocks, SparkBlocks, pack
from countershift.operators.exact import exact_totals
from countershift.sources.formula import INTERCEPT, Design, compile_formula


@dataclass
class Prepared:
    """Two groups' blocks over the same retained design columns."""

    groups: tuple[Blocks, Blocks]
    columns: list[str]
    dropped: list[str]
    omitted_rows: int
    mode: str
    mean_weight: float
    frame: DataFrame | None = None
    source: dict = field(default_factory=dict)
    packed: DataFrame | None = None

    @property
    def n(self) -> int:
        return int(self.groups[0].total + self.groups[1].total)

    def release(self) -> None:
        for held in (self.frame, self.packed):
            if held is not None:
                held.unpersist()


def resolve(value, data: DataFrame, name: str, scalar: bool = False, default=None) -> Column:
    """A column name, a Column, or (where allowed) a number as a Column."""
    if value is None:
        if default is None:
            raise DecompositionError(f"{name} is needed")
        return F.lit(default)
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        if value not in data.columns:
            raise DecompositionError(f"{name}: no column {value!r}")
        return F.col(f"`{value}`")
    if scalar and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value))
    raise DecompositionError(f"{name} must be a column name or a Column" + " or a number" * scalar)


def binary(column: Column, kind: T.DataType) -> Column:
    """0 or 1, NaN where the value is neither, null where it is missing."""
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, T.StringType):
        value = F.when(column == "0", 0.0).when(column == "1", 1.0)
    else:
        number = column.cast("double")
        value = F.when(number.isNull() | F.isnan(number), F.lit(None)).when(number == 0, 0.0).when(number == 1, 1.0)
        return F.when(number.isNull() | F.isnan(number), F.lit(None).cast("double")).otherwise(F.coalesce(value, F.lit(float("nan"))))
    return F.when(column.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(value, F.lit(float("nan"))))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def project(formula: str | Design, data: DataFrame, group, weights=None, model: str = "qr", censoring=None, event=None, times: str | None = None) -> tuple[DataFrame, list[str]]:
    """The projected frame (g, y, w, freq, cens, event, x_j; doubles) before any filter, and the design's names. ``times`` names how often a row stands."""
    design = compile_formula(formula, data) if isinstance(formula, str) else formula
    if (model == "cqr") != (censoring is not None):
        raise DecompositionError("censoring is needed by, and only allowed with, the cqr model")
    if event is not None and model != "cox":
        raise DecompositionError("event is only allowed with the cox model")
    g, e = resolve(group, data, "group"), resolve(event, data, "event", default=1.0)
    kinds = {f.name: f.dataType for f in data.select(g.alias("g"), e.alias("e")).schema}
    frame = data.select(
        binary(g, kinds["g"]).alias("g"), design.response.alias("y"), resolve(weights, data, "weights", default=1.0).cast("double").alias("w"), (F.col(times).cast("double") if times else F.lit(1.0)).alias("freq"),
        resolve(censoring, data, "censoring", scalar=True, default=0.0).cast("double").alias("cens"), binary(e, kinds["e"]).alias("event"),
        *[c.cast("double").alias(f"x_{j}") for j, (_, c) in enumerate(design.columns)],
    )
    return frame, [name for name, _ in design.columns]


def complete(frame: DataFrame) -> DataFrame:
    """Rows in which everything is finite, and each row's checks: a group or event other than 0 and 1 counts as kept here."""
    checked = [c for c in frame.columns if c not in ("g", "event", "freq")]
    keep = F.col("g").isNotNull() & F.col("event").isNotNull()
    for c in checked:
        keep &= finite(F.col(c))
    return frame.where(keep)


def prepare(formula, data: DataFrame, group, weights=None, model: str = "qr", censoring=None, event=None, kernel_max_mb: float = 64.0, reduce: bool = True, join_equal: bool = False) -> Prepared:
    """``join_equal``: rows that don't fit in memory may be joined with their equals (frequencies other than one)."""
    design = compile_formula(formula, data) if isinstance(formula, str) else formula
    p = len(design.columns)
    joined = equal_rows(data, design, (group, weights, censoring, event), kernel_max_mb) if join_equal else None
    try:
        projected = project(design, data if joined is None else joined, group, weights, model, censoring, event, None if joined is None else TIMES)
        absent = {"freq": joined is None, "cens": censoring is None, "event": event is None}
        constant = {c: 0.0 if c == "cens" else 1.0 for c, so in absent.items() if so} | {f"x_{j}": 1.0 for j, c in enumerate(projected[1]) if c == INTERCEPT}
        return _prepared(*projected, joined, p, kernel_max_mb, reduce, constant)
    finally:
        if joined is not None:
            joined.unpersist()


def _prepared(frame: DataFrame, names: list[str], joined: DataFrame | None, p: int, kernel_max_mb: float, reduce: bool, constant: dict[str, float]) -> Prepared:
    bad_weight = F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")) | (F.col("w") <= 0)
    first = frame.agg(F.sum("freq").cast("long").alias("n"), F.sum(bad_weight.cast("long")).alias("bad_w"), F.sum(F.isnan("g").cast("long")).alias("bad_g"), F.sum(F.isnan("event").cast("long")).alias("bad_e")).first()
    if first["bad_g"]:
        raise DecompositionError("group must be 0 or 1")
    if first["bad_e"]:
        raise DecompositionError("event must be 0 or 1")
    if first["bad_w"]:
        raise DecompositionError("weights must be finite and positive")
    kept = complete(frame)
    # exact, so that weights, and all that is drawn or named by them, are the same bits in every layout
    counts = {int(g): c for g, c in exact_totals(kept, "g", "w", "freq" if joined is not None else None).items()}
    if set(counts) != {0, 1}:
        raise DecompositionError("both groups must have complete rows")
    n = sum(c for c, _ in counts.values())
    mean = float(sum(w for _, w in counts.values()) / n)
    scaled = kept.withColumn("w", F.col("w") / mean if joined is None else F.col("w") / mean * F.col("freq"))
    held = {g: c for g, (c, _) in counts.items()}
    if joined is not None:
        held = {int(r["g"]): r["count"] for r in kept.groupBy("g").count().collect()}
    local = sum(held.values()) * (p + 5) * 8 / 2**20 <= kernel_max_mb
    if local:
        arrow = scaled.toArrow()
        table = {c: np.asarray(arrow.column(c).to_numpy(), float) for c in arrow.column_names}
        order = np.argsort(content_hash(list(table.values())), kind="stable")  # draws go by position, so positions go by content
        table = {c: v[order] for c, v in table.items()}
        x = np.column_stack([table[f"x_{j}"] for j in range(p)])
        groups = []
        for g in (0, 1):
            at = np.flatnonzero(table["g"] == g)
            groups.append(LocalBlocks(x[at], *(table[c][at] for c in ("y", "w", "freq", "cens", "event"))))
        persisted = packed = None
    else:
        if joined is not None:
            persisted = scaled.persist()
            persisted.count()
        # passes read the blocks; rows that differ are kept as rows too only if something reads those
        read = [*(f"x_{j}" for j in range(p)), "y", "w", "freq", "cens", "event"]
        packed = pack(scaled, [c for c in read if c not in constant]).persist()
        packed.count()
        persisted = scaled.persist()
        groups = [SparkBlocks(persisted.where(F.col("g") == g), p, held[g], float(counts[g][0]), constant=constant, packed=packed.where(F.col("g") == g).select("b_")) for g in (0, 1)]
    out = Prepared(tuple(groups), names, [], first["n"] - n, "kernel" if local else "distributed", mean, persisted, packed=packed)
    return reduce_design(out) if reduce else out


#: How often a joined row stands.
TIMES = "times_"
#: Rows are joined with their equals where distinct ones are about this share of all or less.
JOIN_SHARE = 0.5


def equal_rows(data: DataFrame, design: Design, others: tuple, kernel_max_mb: float) -> DataFrame | None:
    """The columns that a model reads, each distinct row once with how often it stands, persisted; None where that saves little."""
    if TIMES in data.columns or any(isinstance(c, Column) for c in others):
        return None
    used = sorted({*design.used, *(c for c in others if isinstance(c, str) and c in data.columns)})
    rows = data.select(*[F.col(f"`{c}`") for c in used])
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*[F.col(f"`{c}`") for c in used]))).first()
    if n * (len(design.columns) + 5) * 8 / 2**20 <= kernel_max_mb or distinct > JOIN_SHARE * n:
        return None
    return rows.groupBy(*[F.col(f"`{c}`") for c in used]).agg(F.count("*").alias(TIMES)).persist()


def content_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row; zeros of either sign are one content."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ (c + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def reduce_design(prepared: Prepared) -> Prepared:
    """Keep the largest set of columns of full rank in both groups."""
    factors = []
    for blocks in prepared.groups:
        largest = blocks.reduce(lambda b: np.abs(b.x).max(axis=0, initial=0.0), np.maximum)
        scale = np.where(largest > 0, largest, 1.0)
        factors.append(blocks.reduce(lambda b, s=scale: triangular(b.x / s), lambda a, b: triangular(np.vstack([a, b]))))
    keep = common_columns(*factors, intercept=0)
    for blocks in prepared.groups:
        if blocks.total <= len(keep):
            raise NotIdentifiedError("a group has no more observations than design columns")
    if len(keep) < len(prepared.columns):
        dropped = [c for j, c in enumerate(prepared.columns) if j not in keep]
        warnings.warn(f"design columns dropped: {', '.join(dropped)}", stacklevel=3)
        select = np.eye(len(prepared.columns))[:, keep]
        prepared.groups = tuple(b.design(select) for b in prepared.groups)
        prepared.columns, prepared.dropped = [prepared.columns[j] for j in keep], prepared.dropped + dropped
    return prepared


def subsample_targets(n0: int, n1: int, size: int, p: int) -> tuple[int, int]:
    """Rows of each group in a stratified subsample; either group keeps p + 1 at least."""
    least = p + 1
    if size > n0 + n1 or size < 2 * least or min(n0, n1) < least:
        raise DecompositionError("the subsample's size is out of range")
    second = round(size * n1 / (n0 + n1))
    second = min(max(second, least, size - n0), n1, size - least)
    return size - second, second


def _smallest_hashes(blocks: SparkBlocks, k: int, seed: int) -> DataFrame:
    """The k rows of least hash: the k-th least is selected exactly, then rows are filtered where they lie."""
    from countershift.control import Control
    from countershift.operators.selection import select_ranks

    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *blocks.names), 11).cast("double")
    hashed = blocks.frame.select(*blocks.names, mixed.alias("hash_"))
    values = SparkBlocks(hashed.selectExpr("0D as x_0", "hash_ as y", "1D as w", "1D as freq", "0D as cens", "1D as event"), 1, blocks.rows, float(blocks.rows))
    cut = float(select_ranks(values, lambda b: b.y[:, None], np.array([float(k)]), float(blocks.rows), Control())[0][0])
    below = hashed.where(F.col("hash_") < cut)
    # equal hashes at the cut are equal rows, so any of them will do
    at_cut = hashed.where(F.col("hash_") == cut).limit(k - below.count())
    return below.unionByName(at_cut).drop("hash_")


def subsample(prepared: Prepared, size: int, seed: int = 1) -> Prepared:
    """Exactly ``size`` rows, without replacement, proportionally by group; the design is reduced again."""
    targets = subsample_targets(*(b.rows for b in prepared.groups), size, prepared.groups[0].p)
    groups = []
    for g, (blocks, k) in enumerate(zip(prepared.groups, targets)):
        if isinstance(blocks, LocalBlocks):
            rows = np.sort(np.random.default_rng([seed, g]).choice(blocks.rows, k, replace=False))
            groups.append(blocks.take(rows))
        else:
            part = _smallest_hashes(blocks, k, seed).persist()
            groups.append(SparkBlocks(part, blocks.width, k, float(k), blocks.transform))
    return reduce_design(Prepared(tuple(groups), list(prepared.columns), list(prepared.dropped), prepared.omitted_rows, prepared.mode, prepared.mean_weight, prepared.frame, packed=prepared.packed))

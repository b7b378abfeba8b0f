"""One interface over a group's rows: matrices in this process, or blocks on the executors.

Every fit is written as sums, reductions and bounded gathers over blocks. In
memory the blocks are slices of NumPy arrays; on a cluster they are the Arrow
batches of a persisted frame, a task adds up its own blocks, and tasks' results
are combined in two levels before they reach the driver, which therefore holds
matrices of the design's width but never rows beyond a stated limit.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.errors import DecompositionError

CHUNK = 50_000
#: Tasks' results are combined on executors first if there are more of them than this.
FAN_IN = 16


#: Rows of a packed block.
PACKED_ROWS = 32_768


class Block(NamedTuple):
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    freq: np.ndarray
    cens: np.ndarray
    event: np.ndarray


def add(a, b):
    """Element-wise sum of equal structures of arrays."""
    if isinstance(a, (tuple, list)):
        return tuple(add(x, y) for x, y in zip(a, b))
    return a + b


class Blocks:
    """Rows of one group. ``rows``: physical rows; ``total``: with frequencies."""

    p: int
    rows: int
    total: float

    def reduce(self, fn: Callable[[Block], object], combine: Callable = add):
        raise NotImplementedError

    def gather(self, fn: Callable[[Block], tuple[np.ndarray, ...]], limit: int | None = None) -> tuple[np.ndarray, ...]:
        """Concatenated arrays of all blocks; more than ``limit`` rows are an error."""
        raise NotImplementedError

    def design(self, transform: np.ndarray) -> Blocks:
        """The same rows with the design multiplied by a matrix."""
        raise NotImplementedError

    def filter(self, fn: Callable[[Block], np.ndarray]) -> Blocks:
        """The rows of which ``fn`` is true."""
        raise NotImplementedError

    def where(self, fn: Callable[[Block], np.ndarray]) -> Blocks:
        """As ``filter``, for reductions and gathers alone: packed rows are not stored again."""
        return self.filter(fn)

    def map_rows(self, fn: Callable[[Block], Block]) -> Blocks:
        """Every block replaced (same rows)."""
        raise NotImplementedError

    def release(self) -> None:
        """Free what ``filter`` keeps."""


#: Rows that an extension or a pilot, which needs them in one process, may bring to the driver; more are refused.
GATHER_ROWS = 20_000_000


class LocalBlocks(Blocks):
    def __init__(self, x, y, w, freq=None, cens=None, event=None):
        n = len(y)
        ones = np.ones(n)
        fill = lambda v: ones if v is None else np.asarray(v, float)
        self.block = Block(np.ascontiguousarray(x, float), np.asarray(y, float), np.asarray(w, float), fill(freq), np.zeros(n) if cens is None else np.asarray(cens, float), fill(event))
        self.p, self.rows, self.total = self.block.x.shape[1], n, float(self.block.freq.sum())

    def chunks(self) -> Iterator[Block]:
        for at in range(0, max(self.rows, 1), CHUNK):
            yield Block(*(v[at : at + CHUNK] for v in self.block))

    def reduce(self, fn, combine=add):
        out = None
        for block in self.chunks():
            value = fn(block)
            out = value if out is None else combine(out, value)
        return out

    def gather(self, fn, limit=None):
        parts = [fn(block) for block in self.chunks()]
        out = tuple(np.concatenate(c) for c in zip(*parts))
        if limit is not None and len(out[0]) > limit:
            raise DecompositionError("more rows than the limit of a gather")
        return out

    def design(self, transform):
        return LocalBlocks(self.block.x @ transform, *self.block[1:])

    def filter(self, fn):
        return self.take(np.flatnonzero(fn(self.block)))

    def map_rows(self, fn):
        return LocalBlocks(*fn(self.block))

    def take(self, rows: np.ndarray) -> LocalBlocks:
        return LocalBlocks(*(v[rows] for v in self.block))

    def reweighted(self, w: np.ndarray, freq: np.ndarray | None = None) -> LocalBlocks:
        b = self.block
        return LocalBlocks(b.x, b.y, w, b.freq if freq is None else freq, b.cens, b.event)


def pack(frame: DataFrame, names: list[str]) -> DataFrame:
    """``g`` and ``b_``: the rows of each group in blocks of doubles, column by column. A pass over them hands blocks to Python, not rows."""

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}

        def block(g: int):
            whole = np.concatenate(held.pop(g), axis=1)
            held[g] = []
            return pa.record_batch([pa.array([g], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["g", "b_"])

        for batch in batches:
            columns = np.array([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])
            for g in (0, 1):
                held[g].append(columns[1:, columns[0] == g])
                if sum(part.shape[1] for part in held[g]) >= PACKED_ROWS:
                    yield block(g)
        for g in (0, 1):
            if any(part.shape[1] for part in held[g]):
                yield block(g)

    return frame.select("g", *names).mapInArrow(run, "g int, b_ binary")


class SparkBlocks(Blocks):
    """``frame`` has x_0 .. x_{p-1}, y, w, freq, cens, event as doubles and is persisted by the caller.

    ``constant`` holds the columns that have one value in all rows; they are not sent to Python. ``packed`` has the others of the same rows as
    blocks (see :func:`pack`), which passes read instead.
    """

    def __init__(self, frame: DataFrame, p: int, rows: int, total: float, transform: np.ndarray | None = None, constant: dict[str, float] | None = None, packed: DataFrame | None = None):
        self.frame, self.width, self.transform, self.constant, self.packed = frame, p, transform, constant or {}, packed
        self.p = p if transform is None else transform.shape[1]
        self.rows, self.total = rows, total
        self.names = [f"x_{j}" for j in range(p)] + ["y", "w", "freq", "cens", "event"]
        self._parts: int | None = None
        self._kept: tuple = ()  # conditions, and the design that each of them sees

    @property
    def sent(self) -> list[str]:
        return [n for n in self.names if n not in self.constant]

    def _block(self) -> Callable[[pa.RecordBatch], Block]:
        width, transform, names, constant = self.width, self.transform, self.names, self.constant

        def build(batch: pa.RecordBatch) -> Block:
            return made([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])

        def made(columns) -> Block:
            held = iter(columns)
            columns = [np.full(len(columns[0]), constant[n]) if n in constant else next(held) for n in names]
            x = np.column_stack(columns[:width])
            return Block(x if transform is None else x @ transform, *columns[width:])

        build.made = made
        return build

    def _read(self) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[Block]]]:
        """What a pass reads, and the blocks of one of its batches."""
        build, sent = self._block(), len(self.sent)
        if self.packed is None:
            return self.frame.select(*self.sent), lambda batch: iter((build(batch),))
        made = build.made
        if self._kept:
            plain, kept, transform = SparkBlocks(None, self.width, 0, 0, None, self.constant)._block().made, self._kept, self.transform

            def made(columns) -> Block:
                b = plain(columns)
                for condition, seen in kept:
                    rows = condition(b if seen is None else b._replace(x=b.x @ seen))
                    b = Block(*(v[rows] for v in b))
                return b if transform is None else b._replace(x=b.x @ transform)

        return self.packed, lambda batch: (made(list(np.frombuffer(cell.as_buffer(), float).reshape(sent, -1))) for cell in batch.column(0))

    def _mapped(self, fn, combine) -> DataFrame:
        rows, blocks = self._read()

        def run(batches):
            out, some = None, False
            for batch in batches:
                for block in blocks(batch):
                    value = fn(block)
                    out, some = (combine(out, value) if some else value), True
            if some:
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], names=["k", "v"])

        return rows.mapInArrow(run, "k int, v binary")

    def reduce(self, fn, combine=add):
        parts = self._mapped(fn, combine)
        if self._parts is None:
            self._parts = self._read()[0].rdd.getNumPartitions()
        n = self._parts
        if n > FAN_IN:

            def merged(frame: pd.DataFrame) -> pd.DataFrame:
                out = None
                for v in frame.sort_values("k")["v"]:
                    value = pickle.loads(v)
                    out = value if out is None else combine(out, value)
                return pd.DataFrame({"k": [frame["k"].min()], "v": [pickle.dumps(out)]})

            parts = parts.groupBy((F.col("k") / int(n**0.5)).cast("int").alias("part")).applyInPandas(merged, "k int, v binary")
        out, rows = None, sorted(parts.collect(), key=lambda r: r["k"], reverse=True)
        while rows:
            value = pickle.loads(rows.pop()["v"])
            out = value if out is None else combine(out, value)
        return out

    def gather(self, fn, limit=None):
        held, blocks = self._read()

        def run(batches):
            for batch in batches:
                for block in blocks(batch):
                    arrays = fn(block)
                    if len(arrays[0]):
                        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(arrays[0])], pa.int64()), pa.array([pickle.dumps(arrays)], pa.binary())], names=["k", "n", "v"])

        found = held.mapInArrow(run, "k int, n long, v binary")
        if limit is not None:
            found = found.persist()
            count = found.agg(F.sum("n")).first()[0] or 0
            if count > limit:
                found.unpersist()
                raise DecompositionError("more rows than the limit of a gather")
        rows = sorted(found.collect(), key=lambda r: r["k"])
        if limit is not None:
            found.unpersist()
        parts = [pickle.loads(r["v"]) for r in rows]
        if not parts:
            empty = fn(Block(np.zeros((0, self.p)), *(np.zeros(0) for _ in range(5))))
            return empty
        return tuple(np.concatenate(c) for c in zip(*parts))

    def design(self, transform):
        joint = transform if self.transform is None else self.transform @ transform
        out = SparkBlocks(self.frame, self.width, self.rows, self.total, joint, self.constant, self.packed)
        out._kept = self._kept
        return out

    def where(self, fn):
        if self.packed is None:
            return self.filter(fn)
        out = SparkBlocks(None, self.width, 0, 0.0, self.transform, self.constant, self.packed)
        out._kept, out._parts = (*self._kept, (fn, self.transform)), self._parts
        rows, total = out.reduce(lambda b: np.array([len(b.y), b.freq.sum()]))
        out.rows, out.total = int(rows), float(total)
        return out

    def _derived(self, fn: Callable[[Block], Block]) -> SparkBlocks:
        (held, blocks), p = self._read(), self.p
        names = [f"x_{j}" for j in range(p)] + self.names[self.width :]

        def run(batches):
            for batch in batches:
                for b in map(fn, blocks(batch)):
                    yield pa.record_batch([pa.array(v) for v in (*b.x.T, *b[1:])], names=names)

        frame = held.mapInArrow(run, ", ".join(f"{n} double" for n in names)).persist()
        count, total = frame.agg(F.count("*"), F.sum("freq")).first()
        return SparkBlocks(frame, p, count, float(total or 0))

    def filter(self, fn):
        def kept(b: Block) -> Block:
            rows = fn(b)
            return Block(*(v[rows] for v in b))

        return self._derived(kept)

    def map_rows(self, fn):
        return self._derived(fn)

    def release(self):
        if self.frame is not None:
            self.frame.unpersist()


class Replications(SparkBlocks):
    """Rows with a multiplier for each of ``reps`` replications, in the binary column ``m_``: a block's ``freq`` is that matrix (rows x reps).

    So one pass reduces all replications together; a block's ``w`` is the weight
    that all of them multiply.
    """

    def __init__(self, frame: DataFrame, p: int, rows: int, total: float, transform: np.ndarray | None, reps: int, kind: type):
        super().__init__(frame, p, rows, total, transform)
        self.reps, self.kind = reps, kind
        self.names = [f"x_{j}" for j in range(p)] + ["y", "w", "m_", "cens", "event"]

    def _block(self) -> Callable[[pa.RecordBatch], Block]:
        width, transform, reps, kind = self.width, self.transform, self.reps, self.kind

        def build(batch: pa.RecordBatch) -> Block:
            held = batch.column(width + 2)
            start = np.frombuffer(held.buffers()[1], np.int32)[held.offset] if len(held) else 0
            m = np.frombuffer(held.buffers()[2], np.uint8)[start : start + len(held) * reps * np.dtype(kind).itemsize].view(kind).reshape(len(held), reps) if len(held) else np.empty((0, reps))
            columns = {k: np.asarray(c.to_numpy(zero_copy_only=False), float) for k, c in enumerate(batch.columns) if k != width + 2}
            x = np.column_stack([columns[k] for k in range(width)])
            return Block(x if transform is None else x @ transform, columns[width], columns[width + 1], m.astype(float), columns[width + 3], columns[width + 4])

        return build

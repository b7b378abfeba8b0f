"""Best-fit packing of tokenised documents into sequences of a fixed length.

The packing depends on the pieces' lengths alone, and there are at most
``capacity`` different lengths. So the driver plans on a histogram (bounded by
the capacity, not by the corpus): for each gap it looks up lengths whose
single, pair or triple sum fills the gap exactly, uses such a combination as
often as the counts allow, and puts the largest length that fits where no
combination does. The plan is a table of runs: ranks ``[start, start + n * m)``
of a length go to ``n`` consecutive sequences, ``m`` pieces in each. Pieces find
their rank by a count per (task, length) and their place by a binary search in
the runs; no document is moved to be packed, and no length, however frequent,
meets in one task.

Defined results: null text counts as empty (a piece of the end token alone);
documents longer than the capacity are cut into pieces of it, nothing else is
cut; equal rows are packed each; null ids are kept; further columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countershift.llm.shared import materialize
from countershift.llm.text import release_memory
from countershift.llm.tokens import word_encoder

#: Counts by task and length (three numbers each) that are broadcast.
BROADCAST_COUNTS = 200_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, local_rank long"


class Plan:
    """Runs of ranks by length; see :func:`plan_packing`."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, n, first sequence, offset
        self.used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0

    def emit(self, n: int, items: list[tuple[int, int]]) -> None:
        """``n`` sequences of these (length, times) items."""
        offset = 0
        for length, times in items:
            self.runs.append((length, int(self.used[length]), n, self.sequences, offset))
            self.used[length] += n * times
            offset += length * times
        self.sequences += n

    def table(self) -> np.ndarray:
        """The runs sorted by (length, first rank)."""
        runs = np.array(self.runs, np.int64).reshape(-1, 5)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _combination(avail: np.ndarray, gap: int) -> list[tuple[int, int]] | None:
    """Available lengths, three at most, that fill the gap exactly; the largest lengths first."""
    if avail[gap]:
        return [(gap, 1)]
    pair = _pair(avail, gap)
    if pair:
        return _counted(pair)
    have = np.flatnonzero(avail[: gap - 1])[::-1]
    for a in have.tolist():
        if 3 * a < gap:
            break
        left = avail[a]
        avail[a] -= 1
        rest = _pair(avail, gap - a)
        avail[a] = left
        if rest and max(rest) <= a:
            return _counted([a, *rest])
    return None


def _pair(avail: np.ndarray, total: int) -> list[int] | None:
    """Two available lengths of this sum, the larger as large as can be."""
    half = total // 2
    if total < 2:
        return None
    low = np.arange(1, half + 1)
    fits = (avail[low] > 0) & (avail[total - low] > 0)
    if total % 2 == 0 and avail[half] < 2:
        fits[-1] = False
    at = int(np.argmax(fits))
    return [total - at - 1, at + 1] if fits[at] else None


def _counted(lengths: list[int]) -> list[tuple[int, int]]:
    return [(a, lengths.count(a)) for a in sorted(set(lengths), reverse=True)]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Plan sequences for ``counts[length]`` pieces of each length up to ``capacity``."""
    plan, avail = Plan(capacity), np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        avail[length] = n
    for length in range(capacity, 0, -1):
        while avail[length]:
            n = int(avail[length])
            times = capacity // length
            # as a seed: one piece a sequence, unless only this length is left to fill it
            avail[length] = 0
            if times > 1 and not avail[: capacity - length + 1].any():
                full, rest = divmod(n, times)
                if full:
                    plan.emit(full, [(length, times)])
                if rest:
                    plan.emit(1, [(length, rest)])
                continue
            # half of them are seeds at most where two fit: the others may complete them
            seeds = n if times == 1 else -(-n // times)
            avail[length] = n - seeds
            _fill(plan, avail, seeds, [(length, 1)], capacity - length)
    return plan


def _fill(plan: Plan, avail: np.ndarray, n: int, items: list[tuple[int, int]], gap: int) -> None:
    """Fill ``n`` equal sequences that have this gap left."""
    todo = [(n, items, gap)]
    while todo:
        n, items, gap = todo.pop()
        if gap == 0:
            plan.emit(n, items)
            continue
        found = _combination(avail, gap)
        if found:
            k = min(n, *[int(avail[a]) // m for a, m in found])
            for a, m in found:
                avail[a] -= k * m
            plan.emit(k, items + found)
        else:
            have = np.flatnonzero(avail[: gap + 1])
            if not len(have):
                plan.emit(n, items)
                continue
            a = int(have[-1])
            m = max(1, min(gap // a, int(avail[a]) // n))
            k = min(n, int(avail[a]) // m)
            avail[a] -= k * m
            todo.append((k, [*items, (a, m)], gap - a * m))
        if n > k:
            todo.insert(len(todo) - (0 if found else 1), (n - k, items, gap))


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document, with their rank among the task's pieces of their length. No shuffle."""

    def run(batches):
        encoder, block = word_encoder(tokenizer), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        tail = b"" if end_id is None else np.uint32(end_id).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or b"") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((doc_id, piece, at // 4, length, zlib.crc32(own), block, int(ranks[length]), own if with_ids else None))
                    ranks[length] += 1
                if len(out) >= 2000:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)
        release_memory()

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int32()), ("local_rank", pa.int64())] + [("ids", pa.binary())] * with_ids)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, PIECE_SCHEMA + ", ids binary" * with_ids)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces (columns ``length``, ``block``, ``local_rank``)."""
    counts = materialize(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "packing-counts")
    plan = plan_packing({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    runs = plan.table()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("block", "length", F.coalesce(before, F.lit(0)).alias("base"))
    # a row for each task and length that it has: few are broadcast, more are merged with the pieces, whose rows are narrow
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_COUNTS else bases.hint("merge")
    ranked = pieces.join(bases, ["block", "length"])
    out = ranked.select(*pieces.columns, (F.col("base") + F.col("local_rank")).alias("rank"))
    return out.mapInArrow(_placer(runs), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def _placer(runs: np.ndarray) -> Callable:
    def run(batches):
        # one sorted key for (length, first rank): ranks of a length stay below the width
        width = int(runs[:, 1].max()) + 1 if len(runs) else 1
        keys = runs[:, 0] * width + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(n).to_numpy(zero_copy_only=False), np.int64) for n in ("length", "rank"))
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            _, start, n, sequence, offset = runs[at].T
            slot, copy = np.divmod(rank - start, n)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(sequence + copy), pa.array(offset + slot * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and offset (and ``ids``, if asked for)."""
    pieces = materialize(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "packing-pieces")
    return place(pieces, capacity).drop("block", "local_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves from ``pack(..., with_ids=True)``: sequence_id, length, ids (bytes), doc_ids. A group holds ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return rows.select("sequence_id", total.alias("length"), joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))

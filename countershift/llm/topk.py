"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length (Euclidean norm) into chunks, so that within a
chunk all lengths are close, and neighbouring chunks make *groups* of a bounded
size; queries make groups too. Every query meets the group of the longest
candidates first and so gets a lower bound of its k-th score. In any other chunk
that bound, divided by the lengths of query and chunk, is the *local cosine
threshold*: over 1, no member can reach the bound and the chunk is left alone
(length pruning); if it is high, the partial product of the query's heaviest
coordinates plus the Cauchy-Schwarz bound of the rest discards most members
first (coordinate pruning); else members shorter than bound / |q| are cut off
(length pruning inside the chunk). What is left is verified by full products,
and bounds rise from chunk to chunk.

A task holds one *cell*: a group of queries and a group of candidates. Queries
go to the cells of the groups that are long enough for them, candidates to the
cells of the query groups that need them, each once for a cell. Of the groups
(their number is the bytes over ``GROUP_BYTES``) the driver sees one number each.

Of equal vectors only the k + 1 smallest ids are candidates, since no other can
be in a result. Products of integers below 2**53 are exact in doubles.

Defined results: rows whose id or vector is null, or whose vector holds a null
or non-finite component, take no part; vectors of different dimension never
meet; equal rows (id and vector) count once; a row that shares the query's id is
the query's own; ties go to the smaller id; fewer candidates than k give all;
an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countershift.llm.shared import drop, materialize

CHUNK_ROWS = 4096
QUERY_ROWS = 1024
#: Bytes of a group's vectors at most (a single row may hold more), and groups of candidates that are made where there are rows enough.
GROUP_BYTES = 64 << 20
GROUPS = 40
#: Local cosine thresholds from here on prune by coordinates, lower ones by length.
COORDINATE_FROM = 0.6
#: How many of a query's heaviest coordinates the partial product takes.
FOCUS = 16


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (array<double>) of the rows that take part, each once."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.where(F.col(id_col).isNotNull() & fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()


def first_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """Without the members of groups of equal vectors that can't be among anybody's k: all but the k + 1 smallest ids.

    Equal vectors score alike and ties go to smaller ids, so no result changes.
    Groups are found by a count of hashes; their members are ranked in 64 parts
    first, so that a group of any size is spread.
    """
    hashed = rows.withColumn("h", F.xxhash64("v"))
    large = materialize(hashed.groupBy("h").count().where(F.col("count") > k + 1).select("h"), "topk-equals")
    n = large.count()
    if not n:
        drop(large)
        return rows
    keys = F.broadcast(large) if n <= 100_000 else large
    members = hashed.join(keys, "h", "left_semi").withColumn("salt", F.pmod("id", F.lit(64)))
    for by in (["h", "v", "salt"], ["h", "v"]):
        members = members.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("place") <= k + 1)
    return hashed.join(keys, "h", "left_anti").select(*rows.columns).unionByName(members.select(*rows.columns))


def _groups(rows: DataFrame, least: int, size: int, order: list) -> DataFrame:
    """Rows as matrices (``ids``, ``m``) of at most ``size`` rows of one dimension, in the given order; ``grp`` numbers their range partitions from 0."""

    def run(batches):
        number, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, vectors = batch.column("id").to_numpy(), batch.column("v")
            for k in range(batch.num_rows):
                v = vectors[k].values.to_numpy(zero_copy_only=False) if len(vectors[k]) else np.empty(0)
                own = held.setdefault(len(v), [])
                own.append((ids[k], v))
                if len(own) == size:
                    yield _blob(number, own)
                    held[len(v)] = []
        for own in held.values():
            if own:
                yield _blob(number, own)

    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    partitions = max(1, min(least, -(-n // size)), math.ceil(8 * total / GROUP_BYTES))
    # coalescing joins neighbouring ranges, should the session deal more of them than asked for
    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).coalesce(partitions).mapInArrow(run, _BLOB)


_BLOB = "grp int, dim int, ids binary, m binary, longest double"


def _blob(number: int, rows: list) -> pa.RecordBatch:
    m = np.array([v for _, v in rows], np.float64).reshape(len(rows), -1)
    longest = float(np.sqrt((m * m).sum(axis=1)).max())
    ids = np.array([i for i, _ in rows], np.int64).tobytes()
    columns = [pa.array([number], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([ids], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([longest])]
    return pa.record_batch(columns, names=["grp", "dim", "ids", "m", "longest"])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def score_block(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the vec_ids and scores of the k best candidates at most whose score isn't below the query's bound."""
    lengths, sizes = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    longest = lengths.max(initial=0.0)
    slack = 1e-9 * (1.0 + longest * sizes.max(initial=0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(sizes * longest > 0, bounds / (sizes * longest), np.where(bounds > 0, np.inf, -np.inf))
    out = [(np.empty(0, np.int64), np.empty(0))] * len(q)
    for i in np.flatnonzero(local <= 1 + 1e-12):
        bound, vector = bounds[i], q[i]
        if not np.isfinite(bound) or bound <= 0:
            rows = None
        elif local[i] >= COORDINATE_FROM and m.shape[1] > 2 * FOCUS:
            focus = np.argpartition(-np.abs(vector), FOCUS)[:FOCUS]
            part = m[:, focus]
            rest = np.sqrt(np.maximum(sizes[i] ** 2 - (vector[focus] ** 2).sum(), 0) * np.maximum(lengths**2 - (part * part).sum(axis=1), 0))
            rows = np.flatnonzero(part @ vector[focus] + rest >= bound - slack)
        else:
            rows = np.flatnonzero(lengths * sizes[i] >= bound - slack)
        scores, who = (m @ vector, ids) if rows is None else (m[rows] @ vector, ids[rows])
        fits = (who != q_ids[i]) & (scores >= bound)
        scores, who = scores[fits], who[fits]
        best = _best(scores, who, k)
        out[i] = who[best], scores[best]
    return out


def _cell(queries: pd.DataFrame, chunks: pd.DataFrame, k: int) -> pd.DataFrame:
    """One cell: a row per block of queries with its bounds afterwards, and rows of its hits."""
    read = [(c.dim, np.frombuffer(c.ids, np.int64), np.frombuffer(c.m, np.float64)) for c in chunks.sort_values("longest", ascending=False).itertuples()]
    out = [_rows()]
    for row in queries.itertuples():
        q_ids = np.frombuffer(row.ids, np.int64)
        q = np.frombuffer(row.m, np.float64).reshape(len(q_ids), row.dim)
        bounds = np.full(len(q), -np.inf) if row.lows is None else np.frombuffer(row.lows, np.float64).copy()
        best = [(np.empty(0, np.int64), np.empty(0))] * len(q)
        for dim, ids, m in read:
            if dim != row.dim:
                continue
            found = score_block(q_ids, q, bounds, ids, m.reshape(len(ids), dim), k)
            for i, (who, scores) in enumerate(found):
                if len(who):
                    who, scores = (np.concatenate(x) for x in zip(best[i], (who, scores)))
                    top = _best(scores, who, k)
                    best[i] = who[top], scores[top]
                    if len(top) == k:
                        bounds[i] = max(bounds[i], best[i][1][-1])
        sizes = np.sqrt((q * q).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(bounds > 0, bounds / sizes, -np.inf).min(initial=np.inf)
        out.append(_rows(block=[row.block], grp=[row.grp], lows=[bounds.tobytes()], least=[float(least)]))
        counts = [len(who) for who, _ in best]
        out.append(_rows(query_id=np.repeat(q_ids, counts), vec_id=np.concatenate([w for w, _ in best]), score=np.concatenate([s for _, s in best])))
    return pd.concat(out)


_CELL = "block long, grp long, lows binary, least double, query_id long, vec_id long, score double"
_CELL_TYPES = {"block": "Int64", "grp": "Int64", "lows": "object", "least": "Float64", "query_id": "Int64", "vec_id": "Int64", "score": "Float64"}


def _rows(**columns) -> pd.DataFrame:
    """A frame of a cell's result, null where a column isn't given."""
    n = max(map(len, columns.values()), default=0)
    return pd.DataFrame({c: pd.Series(columns.get(c, [None] * n), dtype=t) for c, t in _CELL_TYPES.items()})


def _dealt(rows: DataFrame, reach: np.ndarray, bounds: np.ndarray, column: str, chunks: bool, cells: int) -> DataFrame:
    """Rows once for each group of the other kind that they meet: ``cell``, then the row. ``reach`` and ``bounds`` have the
    longest length of the candidate groups and the least needed length of the query groups."""

    def run(batches):
        for batch in batches:
            grp, length = batch.column("grp").to_pylist(), batch.column(column).to_pylist()
            for k in range(batch.num_rows):
                if chunks:
                    own = grp[k] + np.flatnonzero(length[k] >= bounds * (1 - 1e-9)) * cells
                else:
                    own = grp[k] * cells + np.flatnonzero(reach >= length[k] * (1 - 1e-9))
                own = own[(own % cells > 0)]
                for cell in own.tolist():
                    yield pa.record_batch([pa.array([cell], pa.int64()), *batch.slice(k, 1).columns], names=["cell", *batch.schema.names])

    return rows.mapInArrow(run, "cell long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query: query_id, rank (from 1), vec_id, score (double)."""
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = materialize(usable(vectors, id_col, vector_col).withColumn("size", size), "topk-rows")
    candidates = materialize(first_of_equals(rows, k), "topk-candidates")
    chunks = materialize(_groups(candidates, GROUPS, CHUNK_ROWS, [F.col("size").desc(), F.col("id")]), "topk-chunks")
    asked = materialize(usable(queries, id_col, vector_col), "topk-asked")
    blocks = _groups(asked, 1, QUERY_ROWS, [F.col("id")]).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks, "topk-blocks")
    drop(rows, asked, candidates)
    search = lambda one, two: _cell(one, two, k)

    # the longest candidates bound every query's k-th score from below: a cell for each group of queries
    n_queries = (blocks.agg(F.max("grp")).first()[0] or 0) + 1
    longest = blocks.select(F.col("grp").cast("long").alias("cell"), "*", F.lit(None).cast("binary").alias("lows"))
    head = chunks.where("grp = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("cell"), "*")
    first = materialize(longest.groupBy("cell").cogroup(head.groupBy("cell")).applyInPandas(search, _CELL), "topk-bounds")
    lows = first.where("lows is not null").select("block", "lows", "least")

    # every other cell: the groups that are long enough for a query
    reach = {r[0]: r[1] for r in chunks.groupBy("grp").agg(F.max("longest")).collect()}
    needs = {r[0]: r[1] for r in first.where("lows is not null").groupBy("grp").agg(F.min("least")).collect()}
    cells = max(reach, default=0) + 1
    reach = np.array([reach.get(g, -np.inf) for g in range(cells)])
    needs = np.array([needs.get(g, np.inf) for g in range(n_queries)])
    one = _dealt(blocks.join(lows, "block"), reach, needs, "least", False, cells)
    two = _dealt(chunks, reach, needs, "longest", True, cells)
    later = one.groupBy("cell").cogroup(two.groupBy("cell")).applyInPandas(search, _CELL)
    hits = first.union(later).where("vec_id is not null").select("query_id", "vec_id", "score")
    # a query has k hits of each cell at most, and few cells reach its bound
    merged = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))

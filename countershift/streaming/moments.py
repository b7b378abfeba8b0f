"""Least squares kept up to date over a stream: its moments add up, so batches only add rows to a table.

Each micro-batch appends one row of sums per group to a Parquet folder named by
the batch's number, so a batch that runs twice writes the same folder again. A
fit reads the sums, never the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.functions.linalg import solve_normal


def moments(frame: DataFrame, y: str, x: list[str], weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums w x x', w x y, w y y and w, one row per group; one aggregate inside whole-stage code."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    target = F.col(y).cast("double")
    sums = [F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * target * target).alias("yy")]
    for i, a in enumerate(columns):
        sums.append(F.sum(w * a * target).alias(f"xy_{i}"))
        sums += [F.sum(w * a * columns[j]).alias(f"xx_{i}_{j}") for j in range(i + 1)]
    return frame.groupBy(*(by or [])).agg(*sums)


def solve(row, p: int) -> np.ndarray:
    gram = np.array([[row[f"xx_{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])
    return solve_normal(gram, np.array([row[f"xy_{i}"] for i in range(p)]))


def keep_moments(stream: DataFrame, path: str, checkpoint: str, y: str, x: list[str], weight: str | None = None, by: list[str] | None = None, available_now: bool = True):
    """Start the query that appends moments below ``path``."""

    def batch(frame: DataFrame, number: int) -> None:
        moments(frame, y, x, weight, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fitted(spark, path: str, x: list[str], by: list[str] | None = None) -> dict[tuple, np.ndarray]:
    """Coefficients by group from everything seen so far."""
    table = spark.read.parquet(path)
    names = [c for c in table.columns if c == "n" or c == "w" or c.startswith(("xx_", "xy_", "yy"))]
    rows = table.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {tuple(r[b] for b in by or []): solve(r, len(x) + 1) for r in rows}

"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate (a node's least neighbour, combined before the
shuffle) and a join back to the edges, which adaptive execution can split when
one node holds most edges. Edges stay in shared Parquet between steps; only a
count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.shared import drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (least node reachable) for every node of an edge.

    Null ends and self-loops are ignored; repeated edges and either direction
    are allowed; no edges give no rows.
    """
    now = materialize(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"), "cc")
    before = None
    while (state := _state(now)) != before:
        if not state[0]:
            break
        before = state
        after = materialize(_small_star(_large_star(now)), "cc")
        drop(now)
        now = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
    out._shared_path = now._shared_path
    return out

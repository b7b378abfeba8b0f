"""How did order values change, and how much of it is a change of mix? A batch decomposition with standard errors.

For every market segment, orders before and from a cutoff date are compared: the
mean value and the shares of orders up to given values are split into what the
mix of priorities and regions explains (composition), what differs inside these
cells (structure), and their total. Standard errors come from a multiplier
bootstrap whose numbers follow from order and replication, and bands from the
largest deviation over a segment's measures.

All replications are sums by segment, side, cell and replication in one pass
over the orders, combined before the shuffle: what is shuffled does not grow
with the orders. Only the read columns of orders, customers and nations are
scanned. Output is partitioned by segment; a rerun overwrites the partitions
with the same rows. Orders without a customer, or with a null value or date,
take no part; null and empty segments are one, which reads as null, and so are
null and empty priorities.

    python -m jobs.order_gap --orders PATH --customers PATH --nations PATH --output PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countershift.functions.curves import normal_quantile
from countershift.operators.cells import differences, mixed
from countershift.operators.frame import bands, hash_exponential

log = logging.getLogger("jobs.order_gap")
#: Decimals of an effect that are kept before errors are taken.
DIGITS = 9
REPORT = "measure string, effect string, estimate double, std_error double, pointwise_lower double, pointwise_upper double, uniform_lower double, uniform_upper double, segment string"


def read_config(path: str | None = None) -> dict:
    return json.loads(Path(path or Path(__file__).with_suffix(".json")).read_text())


def rows(orders: DataFrame, customers: DataFrame, nations: DataFrame, cutoff: str) -> DataFrame:
    """segment, g (1: from the cutoff), cell, y (value), k (order)."""
    # only what is read, so that further columns can't clash
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers, nations = customers.select("c_custkey", "c_nationkey", "c_mktsegment"), nations.select("n_nationkey", "n_regionkey")
    where = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select("c_custkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), "n_regionkey")
    dated = orders.where("o_totalprice is not null and o_orderdate is not null and not isnan(o_totalprice)")
    joined = dated.join(where, dated["o_custkey"] == where["c_custkey"])
    cell = F.concat_ws("/", F.coalesce("o_orderpriority", F.lit("")), F.col("n_regionkey").cast("string"))
    return joined.select("segment", (F.col("o_orderdate") >= F.lit(cutoff).cast("timestamp")).cast("int").alias("g"), cell.alias("cell"), F.col("o_totalprice").cast("double").alias("y"), F.col("o_orderkey").alias("k"))


def replicated(data: DataFrame, thresholds: list[float], replications: int) -> tuple[DataFrame, list[str]]:
    """Sums by segment, g, cell and rep (0: the data themselves), and the names of the measures."""
    each = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(replications))).alias("rep"))
    weighted = each.withColumn("w", F.when(F.col("rep") == 0, 1.0).otherwise(hash_exponential(F.col("k"), F.col("rep"))))
    measures = {"mean": F.col("w") * F.col("y")} | {f"up to {t:g}": F.when(F.col("y") <= float(t), F.col("w")).otherwise(0.0) for t in thresholds}
    named = {f"m{i}": c for i, c in enumerate(measures.values())}
    sums = weighted.groupBy("segment", "g", "cell", "rep").agg(F.sum("w").alias("w"), *[F.sum(c).alias(n) for n, c in named.items()])
    return sums, list(measures)


def report(data: DataFrame, config: dict) -> DataFrame:
    sums, names = replicated(data, config["thresholds"], config["replications"])
    columns = [f"m{i}" for i in range(len(names))]
    levels = mixed(sums, ["segment", "rep"], [], columns)
    long = levels.select("segment", "rep", "d", F.explode(F.array(*[F.struct(F.lit(i).alias("quantile"), F.col(c).alias("value")) for i, c in enumerate(columns)])).alias("x"))
    effects = differences(long.select("segment", "rep", "d", "x.quantile", "x.value"), ["segment", "rep", "quantile"], "value")
    # the last bits of a sum follow the tasks' order; an effect that is nothing but these must not have an error of its own
    effects = effects.withColumn("estimate", F.round("estimate", DIGITS))
    # a few rows per segment and replication; both sides below read the one shuffle
    point, draws = effects.where("rep = 0").drop("rep"), effects.where("rep > 0")
    found = bands(draws, point, config["alpha"], normal_quantile(1 - config["alpha"] / 2), ["segment", "effect"])
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("quantile") + 1)
    return found.select(label.alias("measure"), "effect", *[F.round(c, 6).alias(c) for c in ("estimate", "std_error", "pointwise_lower", "pointwise_upper", "uniform_lower", "uniform_upper")], "segment")


def run(spark: SparkSession, orders: str, customers: str, nations: str, output: str, config: dict | None = None) -> dict:
    """Write the report of the tables at these paths; returns what was read and written."""
    config = config or read_config()
    tables = [spark.read.parquet(p) for p in (orders, customers, nations)]
    read = tables[0].count()
    log.info("read %d orders from %s", read, orders)
    made = report(rows(*tables, config["cutoff"]), config)
    made.repartition("segment").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(output)
    written = spark.read.schema(REPORT).parquet(output).count()
    log.info("wrote %d rows to %s", written, output)
    return {"read": read, "written": written, "report": output}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("orders", "customers", "nations", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    options = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("order_gap").getOrCreate()
    try:
        print(json.dumps(run(spark, options.orders, options.customers, options.nations, options.output, read_config(options.config))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

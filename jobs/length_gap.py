"""Why are documents of one language longer than another's? An incremental decomposition over a growing folder of documents.

For every language, the gap to a reference language in words per document is
split at the mean and at quantiles into what the mix of sources explains
(composition), what differs inside sources (structure), and their total.

Input: Parquet files with columns ``text``, ``lang`` and ``source`` (others are
not read) in a folder that grows. A file stream with ``availableNow`` and a
checkpoint takes only files that no earlier run has taken, cuts them into
micro-batches, and appends one small table of counts by language, source and
number of words per batch: ``<output>/counts/batch=N``. A batch that runs twice,
because a run was killed, overwrites its own folder with the same rows. The
report is made of the counts, never of texts read before, and overwrites its
partitions: ``<output>/report/lang=...``. So a rerun without new files leaves
the same report, and many runs over a growing folder leave that of one run over
all of it.

Null texts have no words; null and empty names of languages, and of sources, are
one (a partition of the report that reads as null). A language without a source in common with the reference has no rows.

    python -m jobs.length_gap --documents PATH --output PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countershift.operators.cells import differences, distribution_quantiles, mixed, words

log = logging.getLogger("jobs.length_gap")
COUNTS = "lang string, source string, words long, n long"
REPORT = "effect string, measure string, estimate double, reference_docs long, documents long, lang string"


def read_config(path: str | None = None) -> dict:
    return json.loads(Path(path or Path(__file__).with_suffix(".json")).read_text())


def count(docs: DataFrame) -> DataFrame:
    """Documents by language, source and number of words; combined before the shuffle."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), words("text").alias("words"))
    return named.groupBy("lang", "source", "words").agg(F.count("*").alias("n"))


def take_new(spark: SparkSession, documents: str, counts: str, checkpoint: str, files_per_batch: int) -> int:
    """Count the files that no run with this checkpoint has counted; returns the rows read."""
    columns = spark.read.parquet(documents).select("text", "lang", "source").schema
    # as a pattern the path may also be that of one file, which a stream refuses otherwise
    path = documents.rstrip("/")
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)

    def batch(frame: DataFrame, number: int) -> None:
        count(frame).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        log.info("batch %d written to %s/batch=%d", number, counts, number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def counted(spark: SparkSession, counts: str) -> DataFrame:
    """The counts of all batches; none yet is an empty table."""
    try:
        table = spark.read.schema(COUNTS).parquet(counts)
    except AnalysisException:  # no batch has been written
        table = spark.createDataFrame([], COUNTS)
    return table.groupBy("lang", "source", "words").agg(F.sum("n").alias("n"))


def report(counts: DataFrame, reference: str, probs: list[float]) -> DataFrame:
    """Effects of every language against the reference, from counts alone."""
    rows = counts.select("lang", F.col("source").alias("cell"), F.col("words").alias("y"), F.col("n").cast("double").alias("w"))
    base, others = rows.where(F.col("lang") == reference).drop("lang"), rows.where(F.col("lang") != reference)
    # the reference's rows once for every language that has their source
    held = others.select("lang", "cell").distinct()
    sides = others.withColumn("g", F.lit(1)).unionByName(base.join(held, "cell").withColumn("g", F.lit(0)))
    levels = distribution_quantiles(sides, ["lang"], "y", probs).withColumn("measure", F.concat(F.lit("q"), F.col("p").cast("string")))
    means = mixed(sides.withColumn("total", F.col("w") * F.col("y")), ["lang"], [], ["total"]).withColumn("measure", F.lit("mean"))
    every = levels.select("lang", "d", "measure", F.col("q").cast("double").alias("value")).unionByName(means.select("lang", "d", "measure", F.col("total").alias("value")))
    both = sides.groupBy("lang", "cell").agg(F.sum(F.when(F.col("g") == 0, F.col("w"))).alias("w0"), F.sum(F.when(F.col("g") == 1, F.col("w"))).alias("w1")).where("w0 > 0 and w1 > 0")
    sizes = both.groupBy("lang").agg(F.sum("w0").cast("long").alias("reference_docs"), F.sum("w1").cast("long").alias("documents"))
    return differences(every, ["lang", "measure"], "value").join(sizes, "lang").select("effect", "measure", F.round("estimate", 6).alias("estimate"), "reference_docs", "documents", "lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take what is new below ``documents`` and bring the report up to date; returns what was read and written."""
    config = config or read_config()
    counts, target = f"{output}/counts", f"{output}/report"
    read = take_new(spark, documents, counts, checkpoint, config["files_per_batch"])
    log.info("read %d new documents from %s", read, documents)
    made = report(counted(spark, counts), config["reference"], config["probs"])
    made.repartition("lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(target)
    written = spark.read.schema(REPORT).parquet(target).count()
    log.info("wrote %d rows to %s", written, target)
    return {"read": read, "written": written, "report": target}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    options = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("length_gap").getOrCreate()
    try:
        print(json.dumps(run(spark, options.documents, options.output, options.checkpoint, read_config(options.config))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

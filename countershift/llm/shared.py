"""Tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again: a lost executor costs a re-read, never a recomputation. Where the
setting is missing (tests, a single machine) a folder of this process is used;
on a cluster its absence is an error, because a machine-local folder would be
invisible to the other machines.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else one of our own on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="countershift-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/countershift/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends: the table that it writes takes their place."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, row_group_mb: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back. Small row groups let large rows be read in small parts."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    with _shuffles_removed(spark):
        (writer.option("parquet.block.size", row_group_mb << 20) if row_group_mb else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def bucketed(slices: list[DataFrame], name: str, column: str, n: int) -> DataFrame:
    """One table of all slices in ``n`` buckets of ``column``: grouping by it needs no shuffle any more, and filters on it skip row groups.

    Slices are shuffled and written one after the other, and the shuffle of each
    is removed before the next, so that the disk holds little more than the table.
    """
    spark = slices[0].sparkSession
    path, table = new_path(spark, name), f"countershift_{uuid.uuid4().hex}"
    for df in slices:
        with _shuffles_removed(spark):
            writer = df.repartition(n, column).write.mode("append").option("compression", "zstd").option("parquet.block.size", 4 << 20)
            writer.bucketBy(n, column).sortBy(column).saveAsTable(table, format="parquet", path=path)
    out = spark.table(table)
    out._shared_path, out._shared_table = path, table
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_shared_path", None)
        if getattr(table, "_shared_table", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._shared_table}")
        if path:
            jvm = table.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def default_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

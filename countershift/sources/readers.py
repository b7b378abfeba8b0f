"""Tables from files: Parquet, ORC, JSON, CSV, or whatever Spark reads by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countershift.errors import DecompositionError


def read_table(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """The format is taken from the path's ending unless given; CSV files have a header, and their types are inferred unless a schema is given."""
    kind = format or path.rstrip("/").rpartition(".")[2].lower()
    if kind == "rds":
        raise DecompositionError("serialised R objects can't be read; write Parquet or CSV instead")
    if kind in ("csv", "tsv"):
        options = {"header": True, "sep": "\t" if kind == "tsv" else ",", "nullValue": "NA", "inferSchema": schema is None} | options
        kind = "csv"
    reader = spark.read.options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).format(kind).load(path)

"""Sinks of an evaluation: the table as CSV, runs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
RECORDS_PER_FILE = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, without row numbers; quotes are doubled.

    A file with line breaks inside values cannot be split by readers, so files
    are kept to a bounded number of records.
    """
    df.write.option("header", True).option("escape", '"').option("maxRecordsPerFile", RECORDS_PER_FILE).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("lineSep", "\n")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def log_runs(runs: DataFrame, path: str) -> None:
    """Append one row per run: parameters as strings, metrics as numbers."""
    runs.select(*[runs[f.name].cast(f.dataType).alias(f.name) for f in RUN_SCHEMA]).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)

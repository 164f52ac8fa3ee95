"""Vector tables on shared storage: one table of committed batches per dimension,
partitioned by database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.operators.embedding import VECTOR
from sqlark.operators.search import of_database
from sqlark.functions.numbering import number_rows
from sqlark.session import materialize, staging
from sqlark.sources.commits import Commit, CommitLog, append

# Explicit, so that a database called '3' stays text instead of becoming a number.
STORE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("entity_id", T.LongType()),
        T.StructField("embedding", VECTOR),
        T.StructField("text", T.StringType()),
        T.StructField("database", T.StringType()),
    ]
)


PATH_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("doc_id", T.LongType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def choose_database(selected: str | None, new_name: str | None) -> str | None:
    """A newly entered name wins over the selected one; empty means none."""
    return new_name or selected or None


def checked_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Fail the job, not the reader, when a vector has the wrong dimension."""
    size = F.size("embedding")
    message = F.concat(F.lit(f"expected {dim} dimensions, not "), size.cast("string"))
    return df.withColumn(
        "embedding",
        F.when(F.col("embedding").isNull() | (size == dim), F.col("embedding")).otherwise(
            F.raise_error(message).cast("array<float>")
        ),
    )


def store_columns(df: DataFrame) -> DataFrame:
    """The stored columns in order; missing ones are NULL, '' is no database."""
    present = {f.name for f in df.schema}
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE_SCHEMA
    ]
    return df.select(*columns).withColumn("database", F.nullif("database", F.lit("")))


class VectorStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, dim: int) -> str:
        return f"{self.root}/vectors_{dim}"

    def stream_path(self, dim: int) -> str:
        """Streams write apart: a batch reader would otherwise trust the
        stream's file log and miss files appended by batch jobs."""
        return f"{self.root}/vectors_{dim}_stream"

    def _scan(self, path: str) -> DataFrame:
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(path)

    def log(self, dim: int) -> CommitLog:
        return CommitLog(self.spark, self.path(dim))

    def batch_rows(self, dim: int) -> DataFrame:
        """Rows of committed appends."""
        rows = self.log(dim).scan(STORE_SCHEMA, "id")
        return self.spark.createDataFrame([], STORE_SCHEMA) if rows is None else rows

    def read(self, dim: int, database: str | None = None) -> DataFrame:
        rows = self.batch_rows(dim)
        if path_exists(self.spark, self.stream_path(dim)):
            rows = rows.unionByName(self._scan(self.stream_path(dim)))
        return of_database(rows, database)

    def append(
        self, vectors: DataFrame, dim: int, database: str | None = None, given_ids: bool | None = None, upload: str | None = None
    ) -> Commit | None:
        """Append as one commit; rows without an ``id`` column get serial ids.

        Ids are given unless the caller says that they count from 1 within this
        append (``given_ids=False``); such ids are moved behind all committed ones.
        Appends at one time get ranges of their own. An ``upload`` that was
        committed before adds nothing, so an append may be tried again.

        The rebalance before the write gives every database files of an even
        size: adaptive execution merges small databases and splits one that
        holds a large share of the rows over many writers.
        """
        if database:
            vectors = vectors.withColumn("database", F.lit(database))
        log = self.log(dim)
        if log.committed(upload):
            return None
        with staging(self.spark):
            if "id" not in vectors.columns:
                vectors, given_ids = number_rows(vectors, "id"), False
            rows = checked_vectors(store_columns(vectors), dim).hint("rebalance", "database")
            return append(log, rows, "id", given_ids is not False, ["database"], upload)

    def delete_all(self, dim: int) -> None:
        """Empty the table of one dimension. Stop a stream into it first."""
        self.log(dim).clear()
        path = self.stream_path(dim)
        if path_exists(self.spark, path):
            writer = self.spark.createDataFrame([], STORE_SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "static")
            writer.partitionBy("database").parquet(path)

    def path_ids(self, paths: DataFrame, upload: str | None = None) -> DataFrame:
        """``path, doc_id`` of each of the ``paths``: the number under which a file is
        stored, 1 and up, the same whenever the path comes again. Of numbers that two
        uploads gave to one new path at the same time the lower one holds."""
        log = CommitLog(self.spark, f"{self.root}/paths")

        def known() -> DataFrame:
            rows = log.scan(PATH_SCHEMA, "doc_id")
            rows = self.spark.createDataFrame([], PATH_SCHEMA) if rows is None else rows
            return rows.groupBy("path").agg(F.min("doc_id").alias("doc_id"))

        asked = materialize(paths.select("path").distinct(), "paths")
        new = asked.join(known(), "path", "left_anti")
        if not new.isEmpty():
            append(log, number_rows(new, "doc_id", ["path"]), "doc_id", upload=upload)
        return asked.join(known(), "path")

    def counts(self, dim: int) -> DataFrame:
        return self.read(dim).groupBy("database").agg(F.count(F.lit(1)).alias("n_rows"))

"""Vectors that were asked for before: (model, text) → vector, by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.operators.embedding import VECTOR, EmbedderFactory, embed
from sqlark.session import materialize
from sqlark.sources.commits import CommitLog, append

_CACHE_SCHEMA = T.StructType(
    [T.StructField("text_key", T.BinaryType()), T.StructField("vector", VECTOR), T.StructField("model", T.StringType())]
)


def text_key(text: Column) -> Column:
    """256 bits of a text's content."""
    return F.unhex(F.sha2(text, 256))


class EmbeddingCache:
    """A table of committed batches, partitioned by model.

    Distinct texts without a vector are embedded once and appended; then all
    rows get their vectors by a join on the content's hash, of which a text that
    fills a large part of the rows is one row. New vectors are written before they
    are used, so a task that is lost repeats its own calls at most, and a later
    upload of equal texts calls nothing. Two uploads at one time may both embed a
    text that is new to both; readers take one of its vectors.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.commits = spark, CommitLog(spark, root.rstrip("/"))

    def vectors(self, model: str) -> DataFrame:
        rows = self.commits.scan(_CACHE_SCHEMA)
        if rows is None:
            rows = self.spark.createDataFrame([], _CACHE_SCHEMA)
        return rows.where(F.col("model") == model).groupBy("text_key").agg(F.first("vector").alias("vector"))

    def embed(self, df: DataFrame, factory: EmbedderFactory, model: str, text: str = "text") -> DataFrame:
        """``df`` with the ``embedding`` of its texts; a null text has a null one."""
        keyed = materialize(df.withColumn("_key", text_key(F.col(text))), "texts-to-embed")
        distinct = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias("text"))
        new = distinct.join(self.vectors(model).withColumnRenamed("text_key", "_key"), "_key", "left_anti")
        # by their keys alone, before any text is moved
        if not new.select("_key").isEmpty():
            # the aggregation has dealt texts evenly by their hash
            embedded = embed(new, factory, "text", "vector")
            append(
                self.commits,
                embedded.select(F.col("_key").alias("text_key"), "vector", F.lit(model).alias("model")),
                partition_by=["model"],
            )
        known = self.vectors(model).select(F.col("text_key").alias("_key"), F.col("vector").alias("embedding"))
        return keyed.join(known, "_key", "left").select(*df.columns, "embedding")

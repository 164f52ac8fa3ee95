"""Scores of generated SQL and metrics of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlark.constants import CHUNK_SIZES, CHUNK_STRATEGIES, EMBEDDING_MODELS


def coincidence(equal: Column, verdict: Column | None = None, contained: Column | None = None) -> Column:
    """1 for equal results; else the supplied verdict decides by containing
    "yes" in any case; without a verdict, containment does."""
    score = F.when(equal, 1)
    if verdict is not None:
        score = score.when(verdict.isNotNull(), F.contains(F.lower(verdict), F.lit("yes")).cast("int"))
    fallback = F.lit(0) if contained is None else F.coalesce(contained, F.lit(False)).cast("int")
    return score.otherwise(fallback).cast("int")


def run_metrics(runs: DataFrame, rows: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Mean similarity and accuracy per run; 0 for a run without rows."""
    means = rows.groupBy(run_id).agg(
        F.avg("similarity").alias("similarity"), F.avg("result_coincidence").alias("accuracy")
    )
    return runs.select(run_id).join(means, run_id, "left").select(
        run_id,
        F.coalesce("similarity", F.lit(0.0)).alias("average_similarity"),
        F.coalesce("accuracy", F.lit(0.0)).alias("average_accuracy"),
    )


def _choices(values: Sequence, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def with_configurations(
    df: DataFrame,
    chunk_sizes: Sequence[int] = CHUNK_SIZES,
    strategies: Sequence[str] = CHUNK_STRATEGIES,
    models: Sequence[str] = EMBEDDING_MODELS,
) -> DataFrame:
    """Every row once per configuration, generated in place without a join."""
    return (
        df.withColumn("chunk_size", F.explode(_choices(chunk_sizes, "int")))
        .withColumn("chunk_strategy", F.explode(_choices(strategies, "string")))
        .withColumn("embedding_model", F.explode(_choices(models, "string")))
    )


def run_name() -> Column:
    """Run id of a configuration."""
    return F.concat_ws("/", F.col("chunk_size").cast("string"), "chunk_strategy", "embedding_model")


def configurations(spark: SparkSession, **axes: Sequence) -> DataFrame:
    one = spark.range(1).select()
    return with_configurations(one, **axes).withColumn("run_id", run_name())


def best_configuration(metrics: DataFrame, config: Sequence[str] | str = "run_id") -> DataFrame:
    """The run with the highest accuracy, then similarity, then lowest name."""
    names = [config] if isinstance(config, str) else list(config)
    return metrics.orderBy(F.desc("average_accuracy"), F.desc("average_similarity"), *names).limit(1)

"""Question sets: JSON objects whose keys are questions and whose values are SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_question_set(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``question, expected_sql`` from files holding one object each, or one per line."""
    objects = spark.read.text(path, wholetext=not per_line)
    parsed = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return objects.select(F.explode(parsed).alias("question", "expected_sql"))

"""Preparation of a training corpus: five stages over whole tables, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sqlark.llm import bpe, decontaminate, toxicity
from sqlark.llm.common import table
from sqlark.llm.line_dedup import drop_shared_lines
from sqlark.llm.near_dedup import keep_one
from sqlark.llm.queries import word_tokenizer
from sqlark.session import collecting, materialize, remove_path


#: Tables that the last stage has left for its result to be read from.
_left: list[str] = []


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the one before it has staged: that one's result has been written by then."""

    @wraps(run)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove_path(spark, _left.pop())
        with collecting() as paths:
            result = run(spark, docs, sf_dir)
        _left.extend(paths)
        return result

    return cleared


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go. It learns from the labels of these documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; every document stays."""
    return drop_shared_lines(docs).select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more are benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, counted and hashed, with the hash of the text they give back."""
    return bpe.digest(bpe.encode(docs, word_tokenizer(), decoded=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Toxicity is a trained model and BPE encoding has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = materialize(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

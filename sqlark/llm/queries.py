"""One query for each operator of this package, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlark.llm import (
    ann,
    bpe,
    brown,
    conversation_repair,
    decontaminate,
    language,
    lexical,
    line_dedup,
    near_dedup,
    quality_rules,
    secret_scan,
    token_files,
    toxicity,
)
from sqlark.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.digest(language.identify(documents, language.learn(language.training(documents))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(
        decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels"))))


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = brown.fit(brown.training(documents))
    return brown.digest(brown.score(documents, model, counts))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, share=ann.LEAN)


def word_tokenizer() -> str:
    """The tokenizer file that the contracts name; installed with every Python."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), word_tokenizer(), decoded=True))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.token_files(table(spark, sf_dir, "documents"), word_tokenizer()))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(
        quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(rows, conversation_repair.audits(rows))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_language,
        op3_secret_scan,
        op4_decontaminate,
        op5_toxicity,
        op6_brown,
        op7_nearest,
        op8_line_dedup,
        op9_bpe,
        op10_token_files,
        op11_quality_rules,
        op12_conversation_repair,
        op13_lexical_search,
    )
}

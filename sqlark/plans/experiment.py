"""The whole experiment: upload, sweep, score, clean."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlark.constants import CHUNK_SIZES, CHUNK_STRATEGIES, EMBEDDING_MODELS, TOP_K
from sqlark.operators.embedding import ModelRegistry, embed
from sqlark.operators.scoring import run_metrics
from sqlark.operators.search import MAX_BROADCAST_ROWS, BatchSearch, Grouping, assemble_context, contexts_of_all, prompt
from sqlark.operators.text import chunk
from sqlark.plans.evaluation import STATEMENT_SECONDS, score_answers
from sqlark.session import materialize, shared_path, spread, staging
from sqlark.sources.catalog import Databases
from sqlark.sources.tracking import log_runs, write_csv

Generator = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Configuration:
    chunk_size: int
    chunk_strategy: str
    embedding_model: str
    dimensions: int

    @property
    def run_id(self) -> str:
        return f"{self.chunk_size}/{self.chunk_strategy}/{self.embedding_model}"

    @property
    def chunk_set(self) -> str:
        """Sentence strategies cut alike whatever the chunk size."""
        return f"fixed-{self.chunk_size}" if self.chunk_strategy == "fixed" else self.chunk_strategy

    @property
    def table(self) -> str:
        return f"vector_embeddings_{self.chunk_size}"


def sweep(
    dimensions: Callable[[int], int] = lambda chunk_size: chunk_size,
    chunk_sizes: Sequence[int] = CHUNK_SIZES,
    strategies: Sequence[str] = CHUNK_STRATEGIES,
    models: Sequence[str] = EMBEDDING_MODELS,
) -> list[Configuration]:
    return [Configuration(c, s, m, dimensions(c)) for c in chunk_sizes for s in strategies for m in models]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def embed_by_model(chunks: DataFrame, models: ModelRegistry, names: Sequence[str]) -> DataFrame:
    """Every text with every model, at the model's full dimension, without the text."""
    return _union([embed(chunks, models.factory(n), keep_text=False).withColumn("model", F.lit(n)) for n in names])


def _per_run(embedded: DataFrame, configs: Sequence[Configuration], models: ModelRegistry, of: Column) -> DataFrame:
    """One row per run that uses the vector, cut to the run's dimension.

    ``of`` names what runs share; the runs of each value are a short literal list.
    """
    by_share: dict[str, list[Configuration]] = {}
    for c in configs:
        by_share.setdefault(f"{c.chunk_set}|{c.embedding_model}", []).append(c)
    runs: Column | None = None
    for share, members in by_share.items():
        entries = F.array(*[F.struct(F.lit(c.run_id).alias("run_id"), F.lit(c.dimensions).alias("dims")) for c in members])
        runs = F.when(of == share, entries) if runs is None else runs.when(of == share, entries)
    fitted: Column | None = None
    exploded = embedded.withColumn("_run", F.explode(runs))
    for name in dict.fromkeys(c.embedding_model for c in configs):
        fit = models.fit(name, "embedding", F.col("_run.dims"))
        fitted = F.when(F.col("model") == name, fit) if fitted is None else fitted.when(F.col("model") == name, fit)
    return exploded.withColumn("run_id", F.col("_run.run_id")).withColumn("embedding", fitted).drop("_run")


def by_run(runs: Sequence[Configuration], models: ModelRegistry) -> Grouping:
    """Vectors of one cutting and model for each run that uses them, cut to the run's
    dimension; runs of one dimension share the cut."""

    wanted = [(r.run_id, r.embedding_model, r.dimensions) for r in runs]

    def group(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.drop_columns(["embedding"])
        fitted: dict[tuple[str, int], pa.ListArray] = {}
        for run_id, *fit in wanted:
            model, dimensions = key = tuple(fit)
            if key not in fitted:
                fitted[key] = models.fit_lists(model, batch.column("embedding"), dimensions)
            columns = [*ids.columns, fitted[key], pa.repeat(run_id, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, [*ids.schema.names, "embedding", "run_id"])

    return group


def retrieve_for_sweep(
    documents: DataFrame,
    questions: DataFrame,
    configs: Sequence[Configuration],
    models: ModelRegistry,
    store: str,
    k: int = TOP_K,
) -> DataFrame:
    """Contexts of all runs: ``run_id, question, context``.

    Chunks are embedded once per cutting and model, not once per run, stored and
    searched; runs that share them are told apart by a group column of the search.
    The store holds the vectors of one cutting and model at a time, without their
    texts, so what stands on disk at once is a share of the whole. Documents are
    staged; the chunks that were hit are cut again for their texts.
    """
    spark = documents.sparkSession
    names = list(dict.fromkeys(c.embedding_model for c in configs))
    docs = materialize(spread(documents.select("doc_id", "text"), "doc_id", "text"), "documents")
    sets = list({c.chunk_set: c for c in configs}.values())
    shared = F.concat_ws("|", "chunk_set", "model")

    chunk_set = F.explode(F.array(*[F.lit(c.chunk_set) for c in sets]))
    asked = embed_by_model(questions.select("question").withColumn("text", F.col("question")), models, names)
    queries = _per_run(asked.withColumn("chunk_set", chunk_set), configs, models, shared)
    search = BatchSearch(queries, k, query_id="question", by="run_id")

    found = []
    for c in sets:
        for name in names:
            runs = [r for r in configs if (r.chunk_set, r.embedding_model) == (c.chunk_set, name)]
            if not runs:
                continue
            vectors = embed_by_model(chunk(docs, c.chunk_strategy, c.chunk_size), models, [name])
            vectors = vectors.withColumn("chunk_set", F.lit(c.chunk_set))
            write_store(vectors, store)
            stored = spark.read.schema(vectors.schema).parquet(store)
            hits = search.within([r.run_id for r in runs]).hits(stored, ["doc_id", "entity_id"], by_run(runs, models))
            found.append(materialize(hits.withColumn("chunk_set", F.lit(c.chunk_set)), "hits"))
    hits, few = _union(found), search.n_queries * k <= MAX_BROADCAST_ROWS
    if few:
        hits = F.broadcast(hits)
    hit_docs = hits.select("chunk_set", "doc_id").distinct()
    texts = []
    for c in sets:
        own = hit_docs.where(F.col("chunk_set") == c.chunk_set)
        hit = docs.join(F.broadcast(own) if few else own, "doc_id", "left_semi")
        texts.append(chunk(hit, c.chunk_strategy, c.chunk_size).withColumn("chunk_set", F.lit(c.chunk_set)))
    with_text = _union(texts).join(hits, ["chunk_set", "doc_id", "entity_id"])
    runs = F.explode(F.array(*[F.lit(c.run_id) for c in configs])).alias("run_id")
    return contexts_of_all(
        questions.select("question", runs), assemble_context(with_text, ["run_id", "question"]), ["run_id", "question"]
    )


def write_store(vectors: DataFrame, store: str) -> None:
    """Vectors in place of what the store has held before."""
    writer = vectors.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
    writer.partitionBy("chunk_set", "model").parquet(store)


def prompts_for(contexts: DataFrame, configs: Sequence[Configuration]) -> DataFrame:
    table_of_run = F.create_map(*[F.lit(x) for c in configs for x in (c.run_id, c.table)])
    return contexts.withColumn("prompt", prompt(table_of_run[F.col("run_id")], "question", "context"))


def run_records(metrics: DataFrame, configs: Sequence[Configuration], k: int) -> DataFrame:
    """Runs as stored: parameters and metrics as maps."""
    params = {
        c.run_id: {
            "chunk_size": str(c.chunk_size),
            "chunk_strategy": c.chunk_strategy,
            "embedding_model": c.embedding_model,
            "top_k": str(k),
        }
        for c in configs
    }
    by_run = F.create_map(
        *[x for run, p in params.items() for x in (F.lit(run), F.create_map(*[F.lit(y) for kv in p.items() for y in kv]))]
    )
    return metrics.select(
        "run_id",
        by_run[F.col("run_id")].alias("params"),
        F.create_map(
            F.lit("average_similarity"), "average_similarity", F.lit("average_accuracy"), "average_accuracy"
        ).alias("metrics"),
    )


@dataclass
class Experiment:
    """Paths and frames of a finished experiment."""

    evaluation: DataFrame
    metrics: DataFrame
    csv: str
    runs: str
    vectors: str


def run_experiment(
    spark: SparkSession,
    documents: DataFrame,
    questions: DataFrame,
    generate: Generator,
    databases: Databases,
    database: str,
    models: ModelRegistry,
    configs: Sequence[Configuration],
    k: int = TOP_K,
    extraction: str = "loose",
    csv_path: str | None = None,
    runs_path: str | None = None,
    seconds: float | None = STATEMENT_SECONDS,
) -> Experiment:
    """``questions`` has ``question, expected_sql``; ``generate`` adds a column
    ``outputs`` to ``run_id, question, expected_sql, prompt`` rows. A statement
    that takes longer than ``seconds`` fails."""
    store = shared_path(spark, "experiment-vectors")
    csv_path = csv_path or shared_path(spark, "evaluation-results")
    runs_path = runs_path or shared_path(spark, "runs")
    with staging(spark):
        contexts = retrieve_for_sweep(documents, questions, configs, models, store, k)
        asked = prompts_for(contexts, configs).join(questions, "question")
        answered = generate(asked.select("run_id", "question", "expected_sql", "prompt"))
        scored = score_answers(spark, answered, databases, database, extraction, seconds=seconds)
        evaluation_path = shared_path(spark, "evaluation")
        scored.write.parquet(evaluation_path)
    evaluation = spark.read.schema(scored.schema).parquet(evaluation_path)
    write_csv(evaluation, csv_path)
    runs = spark.createDataFrame([(c.run_id,) for c in configs], "run_id string")
    metrics = materialize(run_metrics(runs, evaluation), "metrics")
    log_runs(run_records(metrics, configs, k), runs_path)
    # The schema is read before the files go.
    write_store(spark.createDataFrame([], spark.read.parquet(store).schema), store)
    return Experiment(evaluation, metrics, csv_path, runs_path, store)

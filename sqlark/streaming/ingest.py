"""Incremental upload: documents that arrive over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sqlark.operators.embedding import ModelRegistry, compute_vectors
from sqlark.plans.ingest import upload_files
from sqlark.sources.documents import PageExtractor
from sqlark.sources.embedding_cache import EmbeddingCache
from sqlark.sources.vector_store import VectorStore, checked_vectors, store_columns

#: Fixed value: the columns of the file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
_CHUNK_BITS = 21
_DOC_BITS = 63 - _CHUNK_BITS


def stream_row_id(doc: str = "doc_id", entity: str = "entity_id") -> Column:
    """Id of a streamed chunk from its document and chunk number.

    A stream has no view of the whole table to number from. The id is the same
    when a batch is retried, and negative, apart from the serial ids.
    """
    fits = F.col(doc).between(0, (1 << _DOC_BITS) - 1) & F.col(entity).between(0, (1 << _CHUNK_BITS) - 1)
    packed = F.shiftleft(F.col(doc).cast("bigint"), _CHUNK_BITS) + F.col(entity)
    return F.when(fits, -packed - 1).otherwise(F.raise_error(F.lit("document or chunk number too large")).cast("bigint"))


def stream_vectors(
    documents: DataFrame,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    dimensions: int,
    strategy: str = "fixed",
) -> DataFrame:
    """Chunk, embed and number a stream; every step is stateless."""
    keep = [c for c in ("doc_id", "database") if c in documents.columns]
    vectors = compute_vectors(documents, models, model, chunk_size, dimensions, strategy, keep)
    return vectors.withColumn("id", stream_row_id())


def stream_upload(
    store: VectorStore,
    documents: DataFrame,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    checkpoint: str,
    dimensions: int | None = None,
    strategy: str = "fixed",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream. Each document is written exactly once: the checkpoint
    remembers which files were read and the sink's log which were written."""
    dim = chunk_size if dimensions is None else dimensions
    rows = checked_vectors(store_columns(stream_vectors(documents, models, model, chunk_size, dim, strategy)), dim)
    return (
        rows.writeStream.format("parquet")
        .partitionBy("database")
        .option("checkpointLocation", checkpoint)
        .option("path", store.stream_path(dim))
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def arriving_files(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of stored files, ``path, length, content``, each once."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("path", "length", "content")


def stream_files(
    store: VectorStore,
    files: DataFrame,
    extractor: PageExtractor,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    checkpoint: str,
    dimensions: int | None = None,
    strategy: str = "fixed",
    database: str | None = None,
    separator: str = "\n",
    trailing: bool = True,
    cache: EmbeddingCache | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Upload files as they arrive, each as one document whose chunks run across
    its pages: what ``upload_files`` stores, in batches of new files.

    ``files`` are ``path, length, content``, or ``path, length`` of files whose contents
    each batch then reads itself; with an extractor that names a separator nobody
    holds a whole file.

    A file is stored exactly once. The checkpoint remembers which files a batch
    has; the batch is one upload named by checkpoint and number, which a restart
    finds committed or not there at all. A path keeps its document number.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        upload_files(
            store, batch, extractor, models, model, chunk_size, dimensions, strategy, database,
            separator=separator, trailing=trailing, upload=f"{checkpoint}#{number}", cache=cache,
        )

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Upload of documents into a vector table.

Chunks are numbered before they are embedded: what is staged to hand out
serial ids is text, a fraction of the size of the vectors, and the embedder
reads it back in even splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sqlark.functions.numbering import number_rows
from sqlark.operators.embedding import ModelRegistry, create_embeddings
from sqlark.operators.text import chunk, chunk_pages, concat_pages
from sqlark.session import materialize, spread, staging
from sqlark.sources.documents import PageExtractor, extract_pages
from sqlark.sources.embedding_cache import EmbeddingCache
from sqlark.sources.vector_store import VectorStore, choose_database


def _store_chunks(
    store: VectorStore,
    chunks: DataFrame,
    models: ModelRegistry,
    model: str,
    dim: int,
    database: str | None,
    upload: str | None,
    cache: EmbeddingCache | None,
) -> None:
    """Number, embed and append. An ``upload`` that was stored before is neither embedded nor stored again."""
    if store.log(dim).committed(upload):
        return
    with staging(store.spark):
        numbered = number_rows(chunks, "id")
        store.append(create_embeddings(numbered, models, model, dim, cache=cache), dim, database, given_ids=False, upload=upload)


def upload_documents(
    store: VectorStore,
    documents: DataFrame,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    dimensions: int | None = None,
    strategy: str = "fixed",
    database: str | None = None,
    new_database: str | None = None,
    upload: str | None = None,
    cache: EmbeddingCache | None = None,
) -> None:
    """Chunk, embed, number and append ``doc_id, text [, database]`` rows.

    The dimension, and with it the table, defaults to the chunk size. An
    ``upload`` is stored once under its name, however often it is tried; a
    ``cache`` keeps vectors, so that a text is embedded once.
    """
    dim = chunk_size if dimensions is None else dimensions
    keep = [c for c in ("doc_id", "database") if c in documents.columns]
    chunks = spread(chunk(documents, strategy, chunk_size, keep), *keep, "entity_id")
    _store_chunks(store, chunks, models, model, dim, choose_database(database, new_database), upload, cache)


def upload_pages(
    store: VectorStore,
    pages: DataFrame,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    dimensions: int | None = None,
    database: str | None = None,
    new_database: str | None = None,
    separator: str = "",
    trailing: bool = False,
    strategy: str = "fixed",
    upload: str | None = None,
    cache: EmbeddingCache | None = None,
) -> None:
    """The same for documents that arrive as pages of any number.

    Chunks run across the parts of a document, none of which holds more than a
    bounded number of pages.
    """
    dim = chunk_size if dimensions is None else dimensions
    parts = concat_pages(pages, separator=separator, trailing=trailing)
    chunks = spread(chunk_pages(parts, strategy, chunk_size), "doc_id", "entity_id")
    _store_chunks(store, chunks, models, model, dim, choose_database(database, new_database), upload, cache)


def upload_files(
    store: VectorStore,
    files: DataFrame,
    extractor: PageExtractor,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    dimensions: int | None = None,
    strategy: str = "fixed",
    database: str | None = None,
    new_database: str | None = None,
    separator: str = "\n",
    trailing: bool = True,
    upload: str | None = None,
    cache: EmbeddingCache | None = None,
) -> DataFrame:
    """Decode stored files to pages and upload each file as a document.

    Returns ``path, doc_id``: the number under which each file is stored, which
    its path keeps. The pages are decoded once.
    """
    pages = materialize(extract_pages(files, extractor).withColumnRenamed("doc_id", "path"), "pages")
    paths = materialize(store.path_ids(pages, upload), "paths")
    upload_pages(
        store,
        pages.join(paths, "path").select("doc_id", "page_no", "text"),
        models,
        model,
        chunk_size,
        dimensions,
        database,
        new_database,
        separator,
        trailing,
        strategy,
        upload,
        cache,
    )
    return paths

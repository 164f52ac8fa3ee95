"""Texts to vectors through a pluggable embedder, and cuts of vectors.

An embedder is built once per task by a factory and then called with lists of
texts, so a client of a model service is opened once and requests are batched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.constants import EMBEDDING_MODELS, SHORTENING_MODEL
from sqlark.operators.text import chunk
from sqlark.session import spread

Embedder = Callable[[Sequence[str]], np.ndarray]
EmbedderFactory = Callable[[], Embedder]

VECTOR = T.ArrayType(T.FloatType())
TEXTS_PER_CALL = 2048
#: Bytes that stand between tokens: all of ASCII but letters, digits and DEL. None is part of a longer UTF-8 character.
TOKEN_SEPARATORS = bytes(range(0x21)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_SEPARATOR = np.isin(np.arange(256), list(TOKEN_SEPARATORS))


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing: a deterministic stand-in for a model service.

    Each lower-cased token adds +1 or -1 to the entry its MD5 digest names;
    the sum is scaled to unit length. It makes no claim to semantic quality.
    """

    dim: int = 64

    def __call__(self) -> Embedder:
        dim, places = self.dim, _Places(self.dim)

        def embed(texts: Sequence[str]) -> np.ndarray:
            row, tokens = _tokens([text.lower().encode() for text in texts])
            # Each token of the call is looked up once.
            place = places.of(tokens.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(tokens.indices)]
            sums = np.bincount(row * dim + (place >> 1), weights=1.0 - 2 * (place & 1), minlength=len(texts) * dim)
            vectors = sums.astype(np.float64).reshape(len(texts), dim)
            norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)

        return embed


class _Places:
    """Of each token twice its entry, plus one if it counts -1; a bounded number of tokens is remembered."""

    def __init__(self, dim: int, limit: int = 1 << 18):
        self.dim, self.limit, self.known = dim, limit, {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        places = np.fromiter(map(self.known.get, tokens, repeat(-1)), np.int64, len(tokens))
        at = np.flatnonzero(places < 0)
        new = [tokens[i] for i in at.tolist()]
        digests = np.frombuffer(b"".join([hashlib.md5(token).digest() for token in new]), np.uint8).reshape(-1, 16)
        places[at] = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % self.dim * 2 + (digests[:, 4] >> 4 & 1)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
        self.known.update(zip(new[: self.limit], places[at].tolist()))
        return places


def _tokens(texts: Sequence[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text each token stands in, and the tokens, cut as arrays of bytes."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    inside = ~_IS_SEPARATOR[joined]
    # The last byte is a separator, so tokens are pairs of a first byte and the one after their last.
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    first, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])]
    tokens = pa.Array.from_buffers(pa.large_binary(), len(first), buffers).dictionary_encode()
    return np.searchsorted(ends, first, side="right"), tokens


def _vector_column(rows: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list<float> column with NULL where ``missing``."""
    lengths = np.where(missing, 0, rows.shape[1]) if rows.size else np.zeros(len(missing), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = pa.array(np.ascontiguousarray(rows[~missing], dtype=np.float32).ravel())
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def embed(
    df: DataFrame, factory: EmbedderFactory, text: str = "text", name: str = "embedding", keep_text: bool = True
) -> DataFrame:
    """Add the embedding of ``text``; a NULL text has a NULL embedding. Without
    ``keep_text`` it stands in place of the text, which is not handed back.

    A narrow, Arrow-batched pass that also runs on streams. Use
    ``session.spread`` before it when the input has few or uneven splits.
    """
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != at]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, VECTOR, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_CALL):
                batch = whole.slice(start, TEXTS_PER_CALL)
                missing = np.asarray(batch.column(at).is_null())
                texts = batch.column(at).fill_null("").to_numpy(zero_copy_only=False).tolist()
                column = _vector_column(np.asarray(embedder(texts)), missing)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], column], names=schema.names)

    return df.mapInArrow(run, schema)


def cut(embedding: Column | str, dimensions: int | None) -> Column:
    """The first ``dimensions`` entries; ``None`` keeps all."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    return column if dimensions is None else F.slice(column, 1, dimensions)


def shorten(embedding: Column | str, dimensions: int | None) -> Column:
    """Cut, then scale back to unit length; a zero vector stays as it is."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    if dimensions is None:
        return column
    part = F.slice(column, 1, dimensions)
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    # The norm enters as a one-element array so that it is computed once per row, not per entry.
    scaled = F.flatten(
        F.transform(
            F.array(norm),
            lambda n: F.transform(part, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x).cast("float")),
        )
    )
    return F.when(column.isNotNull(), scaled)


def cut_lists(vectors: pa.ListArray, dimensions: int | None) -> pa.ListArray:
    """``cut`` inside a task."""
    return vectors if dimensions is None else pc.list_slice(vectors, 0, dimensions)


def shorten_lists(vectors: pa.ListArray, dimensions: int | None) -> pa.ListArray:
    """``shorten`` inside a task, with the same bits: squares are added one after the other."""
    if dimensions is None:
        return vectors
    part = cut_lists(vectors, dimensions)
    row = np.asarray(pc.list_parent_indices(part))
    entries = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    norms = np.sqrt(np.bincount(row, weights=entries * entries, minlength=len(part)))[row]
    scaled = np.divide(entries, norms, out=entries.copy(), where=norms > 0).astype(np.float32)
    lengths = np.asarray(part.value_lengths().fill_null(0))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = part.is_null() if part.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled), mask=mask)


@dataclass
class ModelRegistry:
    """Model name → embedder factory and how its vectors are shortened."""

    factories: dict[str, EmbedderFactory] = field(default_factory=dict)
    shortening: frozenset[str] = frozenset({SHORTENING_MODEL})

    def register(self, name: str, factory: EmbedderFactory) -> None:
        self.factories[name] = factory

    def factory(self, name: str) -> EmbedderFactory:
        if name not in self.factories:
            raise ValueError(f"unknown embedding model {name!r}, expected one of {sorted(self.factories)}")
        return self.factories[name]

    def fit(self, name: str, embedding: Column | str, dimensions: int | None) -> Column:
        return shorten(embedding, dimensions) if name in self.shortening else cut(embedding, dimensions)

    def fit_lists(self, name: str, vectors: pa.ListArray, dimensions: int | None) -> pa.ListArray:
        """``fit`` inside a task."""
        return shorten_lists(vectors, dimensions) if name in self.shortening else cut_lists(vectors, dimensions)


def hashing_models(dim: int = 64) -> ModelRegistry:
    """Every model name of the sweep, backed by the hashing embedder."""
    return ModelRegistry({name: HashingEmbedder(dim) for name in EMBEDDING_MODELS})


class VectorCache(Protocol):
    """Vectors of texts by model; see ``sources.embedding_cache``."""

    def embed(self, df: DataFrame, factory: EmbedderFactory, model: str, text: str) -> DataFrame: ...


def create_embeddings(
    df: DataFrame,
    models: ModelRegistry,
    model: str,
    dimensions: int | None = None,
    text: str = "text",
    cache: VectorCache | None = None,
) -> DataFrame:
    factory = models.factory(model)
    embedded = cache.embed(df, factory, model, text) if cache else embed(df, factory, text)
    return embedded.withColumn("embedding", models.fit(model, "embedding", dimensions))


def compute_vectors(
    documents: DataFrame,
    models: ModelRegistry,
    model: str,
    chunk_size: int,
    dimensions: int | None = None,
    strategy: str = "fixed",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Chunk, embed and number: ``keep, entity_id, text, embedding``.

    ``dimensions`` defaults to ``chunk_size``. Chunks, which are small and of
    even size, are spread over the cluster before the embedder sees them.
    """
    chunks = chunk(documents, strategy, chunk_size, keep)
    if not documents.isStreaming:
        chunks = spread(chunks, *keep, "entity_id")
    return create_embeddings(chunks, models, model, chunk_size if dimensions is None else dimensions)

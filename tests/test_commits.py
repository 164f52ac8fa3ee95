"""Appends that run at once, fail or are tried again; vectors that are asked for once."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlark.operators.embedding import ModelRegistry, hashing_models
from sqlark.operators.results import SQL_FAILURES
from sqlark.plans.ingest import upload_documents, upload_files
from sqlark.session import shared_path
from sqlark.sources.documents import form_feed_pages, read_document_files
from sqlark.sources.embedding_cache import EmbeddingCache
from sqlark.sources.vector_store import VectorStore

MODEL = "text-embedding-ada-002"
VECTORS = "entity_id long, embedding array<float>, text string"


def vectors(spark, n, text="t"):
    return spark.createDataFrame([(i, [float(i), 1.0], text) for i in range(n)], VECTORS).repartition(3)


def ids(store, dim=2):
    return sorted(r.id for r in store.read(dim).select("id").collect())


def test_appends_at_once_get_ranges_of_their_own(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    sizes = [5, 7, 3, 4]
    failures = []

    def run(n):
        try:
            store.append(vectors(spark, n, f"of {n}"), 2)
        except BaseException as failure:  # noqa: BLE001
            failures.append(failure)

    threads = [threading.Thread(target=run, args=(n,)) for n in sizes]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and ids(store) == list(range(1, sum(sizes) + 1))
    for n in sizes:
        own = sorted(r.id for r in store.read(2).where(F.col("text") == f"of {n}").collect())
        assert own == list(range(own[0], own[0] + n))


def test_given_and_serial_ids(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    store.append(vectors(spark, 3), 2)
    store.append(vectors(spark, 2).withColumn("id", F.col("entity_id") + 40), 2)
    store.append(vectors(spark, 2), 2)
    assert ids(store) == [1, 2, 3, 40, 41, 42, 43]
    store.delete_all(2)
    store.append(vectors(spark, 1), 2)
    assert ids(store) == [1]


def test_a_failed_append_is_not_there(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    store.append(vectors(spark, 3), 2)
    bad = vectors(spark, 50).withColumn("embedding", F.when(F.col("entity_id") == 31, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding")))
    with pytest.raises(SQL_FAILURES):
        store.append(bad, 2)
    # rows that were written but not committed are not read either
    vectors(spark, 9).withColumns({"id": F.lit(1), "doc_id": F.lit(1), "database": F.lit("x")}).write.partitionBy("database").parquet(
        store.log(2).batch_path(store.log(2).new_batch())
    )
    assert ids(store) == [1, 2, 3]
    store.append(vectors(spark, 1), 2)
    assert ids(store) == [1, 2, 3, 4]


def test_an_upload_that_is_tried_again_is_stored_once(spark, tmp_path):
    store = VectorStore(spark, shared_path(spark, "store"))
    documents = spark.createDataFrame([(7, "abcdefghij"), (8, "k")], "doc_id long, text string")
    for name in ("first", "first", "second", "first"):
        upload_documents(store, documents, hashing_models(4), MODEL, 4, upload=name)
    assert ids(store, 4) == list(range(1, 9))
    (tmp_path / "a.txt").write_text("Users write tweets.\f")
    files = read_document_files(spark, str(tmp_path))
    for _ in range(2):
        upload_files(store, files, form_feed_pages, hashing_models(4), MODEL, 4, upload="files")
    assert ids(store, 4) == list(range(1, 14))


def counting_models(path):
    """Models that write a line for each text they are asked for."""

    def factory():
        def embed(texts):
            with open(path, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return np.array([[len(t), sum(map(ord, t)) % 97] for t in texts], dtype=float)

        return embed

    return ModelRegistry({MODEL: factory, "other": factory})


def test_texts_are_embedded_once(spark, tmp_path):
    asked = tmp_path / "asked"
    models = counting_models(str(asked))
    store, cache = VectorStore(spark, shared_path(spark, "store")), EmbeddingCache(spark, shared_path(spark, "cache"))
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaa", "bbbb", "aaaa", None, "cccc", "aaaa"])], "doc_id long, text string")
    upload_documents(store, documents, models, MODEL, 4, 2, cache=cache)
    assert sorted(asked.read_text().split()) == ["aaaa", "bbbb", "cccc"]
    more = documents.union(spark.createDataFrame([(9, "dddd")], documents.schema))
    upload_documents(store, more, models, MODEL, 4, 2, cache=cache)
    assert sorted(asked.read_text().split()) == ["aaaa", "bbbb", "cccc", "dddd"]
    plain = VectorStore(spark, shared_path(spark, "store"))
    for docs in (documents, more):
        upload_documents(plain, docs, models, MODEL, 4, 2)
    rows = lambda s: sorted((r.doc_id, r.entity_id, r.text, tuple(r.embedding)) for r in s.read(2).collect())
    assert rows(store) == rows(plain)
    upload_documents(store, documents, models, "other", 4, 2, cache=cache)
    assert asked.read_text().split()[-3:] != [] and cache.vectors("other").count() == 3 and cache.vectors(MODEL).count() == 4
    found = cache.embed(spark.createDataFrame([(1, None), (2, "aaaa")], "n int, text string"), models.factory(MODEL), MODEL)
    assert sorted((r.n, r.embedding) for r in found.collect()) == [(1, None), (2, [4.0, 0.0])]

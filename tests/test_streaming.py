from pyspark.sql import functions as F

from sqlark.operators.embedding import hashing_models
from sqlark.plans.ingest import upload_documents, upload_files, upload_pages
from sqlark.session import shared_path
from sqlark.sources.documents import form_feed_pages, read_document_files
from sqlark.sources.vector_store import VectorStore
from sqlark.streaming.ingest import arriving_files, stream_files, stream_upload
from tests.conftest import rows

MODEL = "text-embedding-ada-002"
SCHEMA = "doc_id long, text string, database string"


def content(df):
    return sorted((r.doc_id, r.entity_id, tuple(r.embedding), r.text, r.database or "") for r in df.collect())


def test_stream_equals_batch_and_runs_once_per_file(spark):
    first = spark.createDataFrame([(1, "Hello world. " * 9, "a"), (2, "", "a"), (3, "Other text", None)], SCHEMA)
    second = spark.createDataFrame([(4, "Late words", "b")], SCHEMA)
    inbox, checkpoint = shared_path(spark, "inbox"), shared_path(spark, "checkpoint")
    store, batch = (VectorStore(spark, shared_path(spark, "store")) for _ in range(2))
    models = hashing_models(16)

    def run():
        arriving = spark.readStream.schema(SCHEMA).parquet(inbox)
        stream_upload(store, arriving, models, MODEL, 20, checkpoint, 16).awaitTermination()

    first.write.parquet(inbox)
    run()
    run()
    upload_documents(batch, first, models, MODEL, 20, 16)
    assert content(store.read(16)) == content(batch.read(16)) and store.read(16).count() == 7
    second.write.mode("append").parquet(inbox)
    run()
    upload_documents(batch, second, models, MODEL, 20, 16)
    assert content(store.read(16)) == content(batch.read(16))
    ids = [r.id for r in store.read(16).collect()]
    assert len(set(ids)) == len(ids) and max(ids) < 0
    # Batch appends next to the stream are seen as well, and deleting empties both.
    upload_documents(store, second, models, MODEL, 20, 16)
    assert store.read(16).count() == 9
    store.delete_all(16)
    assert store.read(16).count() == 0


def test_upload_numbers_rows_and_takes_the_new_database(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    documents = spark.createDataFrame([(7, "abcdefghij"), (8, "k")], "doc_id long, text string")
    for _ in range(2):
        upload_documents(store, documents, hashing_models(4), MODEL, 4, database="old", new_database="new")
    stored = store.read(4)
    assert sorted(r.id for r in stored.collect()) == list(range(1, 9))
    assert rows(stored.select("doc_id", "entity_id", "text", "database").distinct()) == [
        (7, 0, "abcd", "new"), (7, 1, "efgh", "new"), (7, 2, "ij", "new"), (8, 0, "k", "new"),
    ]


def test_upload_of_pages_cuts_across_pages(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    pages = spark.createDataFrame([(1, 0, "abc"), (1, 1, "defg"), (1, 2, "h")], "doc_id long, page_no long, text string")
    upload_pages(store, pages, hashing_models(4), MODEL, 4)
    assert [r.text for r in store.read(4).orderBy("entity_id").collect()] == ["abcd", "efgh"]
    assert store.counts(4).where(F.col("database").isNull()).first().n_rows == 2


def test_files_as_a_stream_equal_their_upload(spark, tmp_path):
    inbox, checkpoint = tmp_path / "in", shared_path(spark, "checkpoint")
    inbox.mkdir()
    put = lambda name, text: (inbox / name).write_text(text)
    put("a.txt", "Users write tweets. They\ffollow users.\f")
    put("b.txt", "Likes belong to tweets.\f")
    store, batch = (VectorStore(spark, shared_path(spark, "store")) for _ in range(2))
    models = hashing_models(8)

    def run():
        files = arriving_files(spark, str(inbox), "*.txt", files_per_batch=1)
        stream_files(store, files, form_feed_pages, models, MODEL, 10, checkpoint, 8, database="files").awaitTermination()

    run()
    run()
    first = upload_files(batch, read_document_files(spark, str(inbox), "*.txt"), form_feed_pages, models, MODEL, 10, 8, database="files")
    texts = lambda s: sorted((r.entity_id, r.text) for r in s.read(8).collect())
    assert texts(store) == texts(batch) and len(texts(store)) > 5
    put("c.txt", "Late words\f")
    run()
    stored = store.read(8).collect()
    assert sorted(r.id for r in stored) == list(range(1, len(stored) + 1))
    assert sorted({r.doc_id for r in stored}) == [1, 2, 3]
    # a restart that finds its last batch not marked as done stores it under the same name, that is, not again
    again = read_document_files(spark, str(inbox), "c.txt")
    upload_files(store, again, form_feed_pages, models, MODEL, 10, 8, database="files", upload=f"{checkpoint}#2")
    assert store.read(8).count() == len(stored)
    assert {r.path: r.doc_id for r in store.path_ids(first).collect()} == {
        r.path: r.doc_id for r in store.path_ids(read_document_files(spark, str(inbox), "[ab].txt")).collect()
    }

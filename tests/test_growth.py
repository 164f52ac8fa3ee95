"""Steps whose cost must grow no faster than the input."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqlark.operators import embedding, results
from sqlark.operators.embedding import HashingEmbedder, embed, hashing_models, shorten, shorten_lists
from sqlark.operators.integrity import unique_violations
from sqlark.operators.text import chunk, chunk_pages, concat_pages
from sqlark.operators.search import BatchSearch
from sqlark.plans.experiment import retrieve_for_sweep, sweep
from sqlark.session import collecting, shared_path, spread
from sqlark.sources.documents import extract_pages, form_feed_pages, read_document_files
from sqlark.sources.embedding_cache import EmbeddingCache


@pytest.fixture
def turns(spark, tmp_path):
    path = f"{tmp_path}/turns"
    noise = F.sha2(F.col("id").cast("string"), 512)
    spark.range(4000).select((F.col("id") / 8).cast("bigint").alias("doc_id"), (F.col("id") % 8).alias("page_no"), noise.alias("text")).write.parquet(path)
    return spark.read.schema("doc_id bigint, page_no bigint, text string").parquet(path)


def test_a_join_is_not_spread_over_the_square_of_its_input(spark, turns):
    after = turns.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("text").alias("following"))
    pairs = spread(turns.join(after, ["doc_id", "page_no"]), "doc_id", "page_no")
    assert pairs.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert pairs.count() == 3500


def test_chunks_of_pages_are_not_spread_over_a_power_of_their_input(spark, turns):
    # some numbers beyond the first range, so that parts are located by joins
    far = turns.withColumn("page_no", F.when(F.col("doc_id") % 50 == 0, F.col("page_no") + 5000).otherwise(F.col("page_no")))
    chunks = spread(chunk_pages(concat_pages(far), "fixed", 100), "doc_id", "entity_id")
    assert chunks.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert chunks.agg(F.sum(F.length("text"))).first()[0] == 4000 * 129


def test_sweep_stores_vectors_of_one_cutting_and_model_at_a_time(spark, tmp_path):
    words = "users write tweets and follow others. likes belong to tweets! comments too".split(" ")
    docs = [(d, " ".join(words[(d * i) % len(words)] for i in range(1, 40))) for d in range(12)]
    documents = spark.createDataFrame([*docs, (12, None)], "doc_id long, text string")
    asked = [("who likes tweets",), ("comments of others",)]
    configs = sweep(dimensions=lambda size: 32, chunk_sizes=[16, 64], strategies=["fixed", "nltk"], models=["text-embedding-3-small", "text-embedding-ada-002"])
    found = retrieve_for_sweep(documents, spark.createDataFrame(asked, "question string"), configs, hashing_models(32), f"{tmp_path}/store", k=2)
    contexts = {(r.run_id, r.question): r.context for r in found.collect()}
    embedder = HashingEmbedder(32)()
    for c in configs:
        chunks = [tuple(r) for r in chunk(documents, c.chunk_strategy, c.chunk_size).collect()]
        vectors = embedder([t for *_, t in chunks])
        for (question,) in asked:
            far = np.sqrt(((vectors - embedder([question])) ** 2).sum(axis=1)).astype(np.float32)
            best = sorted(range(len(chunks)), key=lambda i: (round(float(far[i]), 6), chunks[i][:2]))[:2]
            assert [contexts[c.run_id, question].find(chunks[i][2]) >= 0 for i in best] == [True, True]
    assert len(contexts) == len(configs) * len(asked)
    stored = spark.read.parquet(f"{tmp_path}/store")
    assert stored.select("chunk_set", "model").distinct().count() == 1 and "text" not in stored.columns


def test_files_reach_an_extractor_in_pieces(spark, tmp_path):
    texts = {"a": "één\ftwee é\f\fdrie\f", "b": "", "c": "no end", "d": "\f", "e": "x" * 50 + "\f" + "é" * 50}
    for name, content in texts.items():
        (tmp_path / f"{name}.txt").write_text(content)
    files = read_document_files(spark, str(tmp_path), "*.txt")
    whole = lambda t: [p for p in t.split("\f")[: -1 if t.split("\f")[-1] == "" else None]]
    wanted = sorted((n, i, p) for n, t in texts.items() for i, p in enumerate(whole(t)))
    for piece_bytes in (1, 7, 1 << 20):
        pages = extract_pages(files, form_feed_pages, piece_bytes)
        assert sorted((r.doc_id[-5], r.page_no, r.text) for r in pages.collect()) == wanted

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["path"], "page_no": batch["piece"], "text": [str(len(c)) for c in batch["content"]]})

    sizes.takes_pieces = True
    assert max(int(r.text) for r in extract_pages(files, sizes, 7).collect()) == 7
    del sizes.takes_pieces
    one_file = lambda batches: (pd.DataFrame({"doc_id": ["x"], "page_no": [len(b)], "text": [""]}) for b in batches)
    assert [r.page_no for r in extract_pages(files.coalesce(1), one_file).collect()] == [1] * (len(texts) - 1)  # Spark lists no empty files


def test_texts_to_embed_are_staged_once(spark):
    cache = EmbeddingCache(spark, shared_path(spark, "cache"))
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None)], "n int, text string")
    for rows in (df.where("n < 2"), df):
        with collecting() as paths:
            found = cache.embed(rows, HashingEmbedder(4), "m")
        assert len(paths) == 1
    vectors = {r.n: r.embedding for r in found.collect()}
    assert vectors[1] == vectors[3] != vectors[2] and vectors[4] is None and len(vectors) == 4
    assert cache.vectors("m").count() == 2 and len(cache.commits.visible()) == 2


def test_unique_keys_are_dealt_out_before_they_are_counted(turns):
    plan = unique_violations(turns, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    twice = turns.union(turns.where("doc_id = 3 and page_no < 2"))
    assert sorted(r.n_rows for r in unique_violations(twice, ["doc_id", "page_no"]).collect()) == [2, 2]


def test_few_columns_are_matched_as_many(spark, monkeypatch):
    expected = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "b", 2.0)], "x int, y string, z double")
    generated = spark.createDataFrame([(1, "a", None, 1), (1, "b", 2, 1), (2, "b", 2, 1), (2, "b", 2, 2)], "p long, q string, r int, s int")
    few = results.possible_columns(expected, generated)
    monkeypatch.setattr(results, "COUNTED_AT_ONCE", 0)
    assert few == results.possible_columns(expected, generated) == [[0, 3], [1], [2]]


def test_a_smaller_result_contains_nothing_larger(spark, monkeypatch):
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert results.contains_result(df, df) and results.contains_result(df.limit(0), df)
    monkeypatch.setattr(results, "possible_columns", None)  # columns are not looked at
    assert not results.contains_result(df, df.distinct())


def test_a_token_is_hashed_once_in_a_call(monkeypatch):
    asked = []
    md5 = hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda token: asked.append(token) or md5(token))
    texts = ["Ein ein_Wort", "", ".;", "wort\x00\x85ein ÉIN\x0bein", "😀 ein\x7f"]
    found = HashingEmbedder(8)()(texts)
    assert sorted(asked) == sorted(t.encode() for t in ("ein", "wort", "\x85ein", "éin", "😀", "ein\x7f"))
    sums = np.zeros((len(texts), 8))
    for row, tokens in enumerate((["ein", "ein", "wort"], [], [], ["wort", "\x85ein", "éin", "ein"], ["😀", "ein\x7f"])):
        for token in tokens:
            digest = md5(token.encode()).hexdigest()
            sums[row, int(digest[:8], 16) % 8] += 1 - 2 * (int(digest[8], 16) & 1)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    assert (found == np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)).all()
    few = embedding._Places(8, limit=2)
    assert [few.of(t).tolist() for t in ([b"a", b"b", b"c"], [b"c", b"a"], [])] == [embedding._Places(8).of(t).tolist() for t in ([b"a", b"b", b"c"], [b"c", b"a"], [])]
    assert len(few.known) <= 2


def test_vectors_are_shortened_alike_in_tasks(spark):
    rows = [[0.1, -2.5, 3.0, 1e-7], [0.0, 0.0, 0.0], None, [], [1e-3] * 7, [3.3]]
    column = pa.array(rows, pa.list_(pa.float32()))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<float>")
    for dims in (None, 1, 3, 9):
        wanted = [r.v for r in df.select("i", shorten("v", dims).alias("v")).orderBy("i").collect()]
        assert shorten_lists(column, dims).to_pylist() == shorten_lists(column.slice(0), dims).to_pylist() == wanted
        assert shorten_lists(column.slice(2), dims).to_pylist() == wanted[2:]


def test_a_row_of_several_groups_is_searched_without_copies_of_it(spark, monkeypatch):
    vectors = [(i, [float(i), 1.0, 2.0]) for i in range(9)]
    corpus = spark.createDataFrame(vectors, "id long, embedding array<float>")
    queries = spark.createDataFrame([("a", "x", [3.2, 1.0]), ("a", "y", [0.1])], "question string, run_id string, embedding array<float>")

    def grouping(batch):
        for run, dims in (("x", 2), ("y", 1)):
            columns = [batch.column("id"), embedding.cut_lists(batch.column("embedding"), dims), pa.repeat(run, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "embedding", "run_id"])

    for most in (1 << 20, 1):  # queries in each task, and queries that meet the corpus in cells
        search = BatchSearch(queries, 2, "question", by="run_id", max_query_bytes=most)
        found = search.hits(corpus, grouping=grouping)
        assert sorted((r.run_id, r["rank"], r.id) for r in found.collect()) == [("x", 1, 3), ("x", 2, 4), ("y", 1, 0), ("y", 2, 1)]


def test_embedded_texts_are_not_handed_back(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "i int, text string, j int")
    found = embed(df, HashingEmbedder(4), keep_text=False)
    assert found.columns == ["i", "j", "embedding"]
    assert [(r.i, r.j, r.embedding is None) for r in found.orderBy("i").collect()] == [(1, 2, False), (2, 3, True)]


def test_no_file_is_held_whole(spark, tmp_path):
    folder = tmp_path / "lang=e n" / "source=a%20{x}+,"
    folder.mkdir(parents=True)
    contents = {
        "plain.txt": "".join(f"page {i} é\n\f" for i in range(3000)).encode() + b"\f\flast", "[b] é.txt": b"\xef\xbb\xbfone\ftwo\f", "mark.txt": b"\xef\xbb\xbf",
        "tail.txt": b"\xef\xbb\xbf\fq", "gap.txt": b"\f", "packed.gz": b"no\fgzip", "none.txt": b"",
    }
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    files = read_document_files(spark, f"{tmp_path}/*/*")
    pages = lambda df: sorted(tuple(r) for r in df.collect())
    wanted = pages(extract_pages(files, form_feed_pages))
    assert len(wanted) == 3011
    small = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        for piece_bytes in (1, 50, 1 << 20):
            found = extract_pages(files.select("path", "length"), form_feed_pages, piece_bytes)
            assert pages(found) == wanted
        assert found.rdd.getNumPartitions() > 30
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert pages(extract_pages(files.limit(0).select("path", "length"), form_feed_pages)) == []
    one_file = lambda batches: (pd.DataFrame({"doc_id": b["path"], "page_no": 0, "text": [str(len(c)) for c in b["content"]]}) for b in batches)
    sizes = sorted(len(c) for c in contents.values() if c)
    assert sorted(int(r.text) for r in extract_pages(files.select("path", "length"), one_file).collect()) == sizes

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlark.functions.nearest import Tile
from sqlark.functions.vectors import euclidean, euclidean_to
from sqlark.operators import embedding as M
from sqlark.operators import search as S
from sqlark.operators.results import SQL_FAILURES
from sqlark.operators.search import BatchSearch, contexts_of_all
from sqlark.plans.ingest import upload_files
from sqlark.session import shared_path
from sqlark.sources.documents import form_feed_pages, read_document_files
from sqlark.sources.vector_store import VectorStore, choose_database
from tests.conftest import rows


def vector_frame(spark, matrix, ids=None, extra="text"):
    ids = range(len(matrix)) if ids is None else ids
    data = [(int(i), None if v is None else [float(x) for x in v], f"text {i}") for i, v in zip(ids, matrix)]
    return spark.createDataFrame(data, "id long, embedding array<float>, text string")


def brute_force(queries, matrix, ids, k):
    found = []
    for q, query in enumerate(queries):
        distance = np.sqrt(((matrix - query) ** 2).sum(axis=1))
        order = np.lexsort((ids, distance.astype(np.float32)))[:k]
        found += [(q, rank, int(ids[o])) for rank, o in enumerate(order, 1)]
    return sorted(found)


def float32(rng, *shape):
    return rng.normal(size=shape).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("width", [3, 200])
def test_distance_expressions(spark, width):
    a, b = float32(np.random.default_rng(1), 2, width)
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<float>, b array<float>")
    found = df.select(euclidean("a", "b"), euclidean_to("a", b.tolist())).first()
    assert found[0] == pytest.approx(np.linalg.norm(a - b), abs=1e-9) and found[1] == pytest.approx(found[0], abs=1e-12)


def test_nearest_puts_missing_vectors_last_and_breaks_ties_by_id(spark):
    df = vector_frame(spark, [[1, 0], None, [0, 1], [3, 0]], ids=[5, 1, 2, 4])
    hits = S.nearest(df, [0.0, 0.0], 4).collect()
    assert [h.id for h in hits] == [2, 5, 4, 1]
    assert [h.score for h in hits] == [1.0, 1.0, 3.0, None]
    assert hits[0].text == "text 2" and hits[0].embedding == [0.0, 1.0]


def test_nearest_of_other_dimension_fails(spark):
    with pytest.raises(SQL_FAILURES):
        S.nearest(vector_frame(spark, [[1, 0]]), [0.0, 0.0, 0.0], 1).collect()


@pytest.mark.parametrize("all_databases", [None, "All"])
def test_database_filter(spark, all_databases):
    df = vector_frame(spark, [[1], [2], [3]]).withColumn("database", F.when(F.col("id") > 0, "b"))
    assert [h.id for h in S.nearest(df, [0.0], 3, database="b").collect()] == [1, 2]
    assert S.nearest(df, [0.0], 3, database=all_databases).count() == 3


@pytest.mark.parametrize("limits", [{}, {"max_query_bytes": 300, "cell_bytes": 2000}])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_batch_search_equals_brute_force(spark, limits, k):
    rng = np.random.default_rng(7)
    matrix, queries = float32(rng, 400, 8), float32(rng, 13, 8)
    matrix[100:250] = matrix[3]  # more than a third of the rows are copies
    queries[4] = matrix[3]
    ids = rng.permutation(400)
    asked = vector_frame(spark, queries).select(F.col("id").alias("query_id"), "embedding")
    corpus = vector_frame(spark, matrix, ids).repartition(5)
    hits = S.BatchSearch(asked, k, **limits).hits(corpus)
    found = sorted((h.query_id, h["rank"], h.id) for h in hits.collect())
    assert found == brute_force(queries, matrix, ids, k)


@pytest.mark.parametrize("limits", [{}, {"max_query_bytes": 40, "cell_bytes": 60}])
def test_batch_search_by_database_and_missing_vectors(spark, limits):
    corpus = vector_frame(spark, [[0], [1], [2], None, [9], None]).withColumn(
        "database", F.when(F.col("id") < 4, "a").when(F.col("id") == 4, "b")
    )
    asked = spark.createDataFrame(
        [("q", [0.0], "a"), ("q", [0.0], "b"), ("r", [2.0], "a"), ("n", None, "a"), ("z", [0.0], "none")],
        "query_id string, embedding array<float>, database string",
    )
    hits = S.BatchSearch(asked, 4, by="database", **limits).hits(corpus).collect()
    found = sorted((h.query_id, h.database, h["rank"], h.id, h.score) for h in hits)
    assert [f[:4] for f in found] == [
        ("q", "a", 1, 0), ("q", "a", 2, 1), ("q", "a", 3, 2), ("q", "a", 4, 3),
        ("q", "b", 1, 4),
        ("r", "a", 1, 2), ("r", "a", 2, 1), ("r", "a", 3, 0), ("r", "a", 4, 3),
    ]
    assert found[3][4] is None


def test_tile_streams_far_to_near(spark):
    """Every step brings better rows than the last: nothing is lost, copies neither."""
    matrix = np.repeat(np.arange(5000, 0, -1.0), 3)[:, None]
    tile = Tile(np.array([[0.0], [2500.0]]), 4, 1)
    tile.add(matrix, [np.arange(len(matrix))])
    assert list(tile.query) == [0] * 4 + [1] * 4
    assert list(tile.ids[0][:4]) == [14997, 14998, 14999, 14994]


@pytest.mark.parametrize("by", [None, "database"])
def test_pivots_equal_brute_force_with_ties(spark, by):
    """Clustered vectors on a coarse grid, so that many distances are equal."""
    rng = np.random.default_rng(11)
    centres = rng.integers(-50, 50, (12, 4))
    matrix = (centres[rng.integers(0, 12, 3000)] + rng.integers(-2, 3, (3000, 4))).astype(float)
    matrix[1000:1900] = matrix[5]
    queries = matrix[rng.integers(0, 3000, 60)] + rng.integers(-1, 2, (60, 4))
    ids = rng.permutation(3000)
    corpus = vector_frame(spark, matrix, ids).repartition(4).withColumn("database", (F.col("id") % 3).cast("string"))
    asked = vector_frame(spark, queries).select(F.col("id").alias("query_id"), "embedding", (F.col("id") % 3).cast("string").alias("database"))
    search = S.BatchSearch(asked if by else asked.drop("database"), 7, by=by, max_query_bytes=500, cell_bytes=4000)
    found = sorted((h.query_id, h["rank"], h.id) for h in search.hits(corpus).collect())
    if by is None:
        assert found == brute_force(queries, matrix, ids, 7)
    else:
        wanted = []
        for q, query in enumerate(queries):
            own = ids % 3 == q % 3
            wanted += [(q, rank, i) for _, rank, i in brute_force([query], matrix[own], ids[own], 7)]
        assert found == sorted(wanted)


def test_pivots_move_fewer_rows_than_the_grid(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 20
    matrix = centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16))
    queries = centres[rng.integers(0, 40, 800)] + rng.normal(size=(800, 16))
    corpus = vector_frame(spark, matrix).select("id", "embedding")
    search = S.BatchSearch(vector_frame(spark, queries).select(F.col("id").alias("query_id"), "embedding"), 5)
    tile, cell = 80 * 16 * 8, 1000 * 16 * 8
    near = S.pivot_sides(search.queries, corpus, "embedding", None, 5, ["id"], 16, tile, cell)
    all_ = S.grid_sides(search.queries, corpus, "embedding", ["id"], 10, 8)
    moved = lambda sides: sum(side.count() for side in sides)
    assert moved(near) < 0.35 * moved(all_)


def test_batch_search_has_no_pairwise_join(spark):
    asked = vector_frame(spark, [[1.0]]).select(F.col("id").alias("query_id"), "embedding")
    hits = S.BatchSearch(asked, 2).hits(vector_frame(spark, [[0], [1]]))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_nested_results_context_and_prompt(spark):
    asked = vector_frame(spark, [[0.0], [5.0]]).select(F.col("id").alias("query_id"), "embedding")
    corpus = vector_frame(spark, [[4], [1], [0]])
    hits = S.BatchSearch(asked, 2).hits_with_text(corpus.select("id", "embedding"), corpus.select("id", "text"))
    nested = S.nested_results(hits).orderBy("query_id").collect()
    assert [(r["id"], r["content"], r["score"]) for r in nested[0]["results"]] == [(2, "text 2", 0.0), (1, "text 1", 1.0)]
    contexts = S.assemble_context(hits).orderBy("query_id")
    assert [c.context for c in contexts.collect()] == ["text 2 text 1", "text 0 text 1"]
    text = contexts.select(S.prompt(F.lit("table_x"), F.lit("How many?"), "context")).first()[0]
    assert "table_x" in text and "How many?." in text and "Context: text 2 text 1\n" in text


def test_database_suffix(spark):
    df = spark.createDataFrame([("t", "d"), ("t", ""), ("t", None)], "task string, db string")
    assert rows(df.select(S.with_database_suffix("task", "db"))) == [("t",), ("t",), ("t\n\nThe database is d",)]


# Embedding -------------------------------------------------------------------


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hashing_embedder(spark):
    df = M.embed(texts_frame(spark, ["Hello, hello world", "", None, "!?"]), M.HashingEmbedder(32))
    found = [r.embedding for r in df.orderBy("doc_id").collect()]
    assert np.linalg.norm(found[0]) == pytest.approx(1.0) and sum(x != 0 for x in found[0]) == 2
    assert max(map(abs, found[0])) == pytest.approx(2 / np.sqrt(5))
    assert found[1] == found[3] == [0.0] * 32 and found[2] is None


def test_embedder_is_built_once_per_task_and_gets_lists(spark):
    def factory():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            return np.array([[len(calls), len(t)] for t in texts], dtype=float)

        return embed

    df = M.embed(texts_frame(spark, ["a"] * 5000).coalesce(1), factory)
    calls = sorted(r[0] for r in df.select(F.col("embedding")[0].cast("int")).distinct().collect())
    assert calls == list(range(1, len(calls) + 1)) and len(calls) < 10


def test_cut_and_shorten(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0],), ([0.0, 0.0, 1.0],), (None,)], "e array<float>")
    cut, short, whole = zip(*df.select(M.cut("e", 2), M.shorten("e", 2), M.cut("e", None)).collect())
    assert cut == ([3.0, 4.0], [0.0, 0.0], None)
    assert short[0] == pytest.approx([0.6, 0.8]) and short[1:] == ([0.0, 0.0], None)
    assert whole[0] == [3.0, 4.0, 12.0]


def test_models_shorten_by_name(spark):
    df = texts_frame(spark, ["one two three four five six"])
    models = M.hashing_models(64)
    sizes = {}
    for name in models.factories:
        vector = M.create_embeddings(df, models, name, 8).first().embedding
        sizes[name] = (len(vector), round(float(np.linalg.norm(vector)), 5))
    assert sizes["text-embedding-3-large"] == (8, 1.0)
    assert sizes["text-embedding-3-small"] == sizes["text-embedding-ada-002"] and sizes["text-embedding-3-small"][1] < 1
    with pytest.raises(ValueError):
        models.factory("unknown")


# Store -----------------------------------------------------------------------


def test_store_appends_reads_back_and_empties(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    assert store.read(2).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, None, "b")], "entity_id long, embedding array<float>, text string")
    store.append(vectors, 2, "3")
    store.append(vectors, 2)
    store.append(vectors.withColumn("database", F.lit("")), 2)
    assert sorted(r.id for r in store.read(2).collect()) == [1, 2, 3, 4, 5, 6]
    assert store.read(2).where("database IS NULL").count() == 4
    assert rows(store.read(2, "3").select("entity_id", "text", "database")) == [(0, "a", "3"), (1, "b", "3")]
    assert store.read(2, "All").count() == 6
    plan = store.read(2, "3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(database" in plan
    store.delete_all(2)
    assert store.read(2).count() == 0 and store.read(2).columns == store.read(3).columns
    store.append(vectors, 2)
    assert store.read(2).count() == 2


def test_wrong_dimension_fails_the_write_and_leaves_nothing(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    bad = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0, 2.0], "b")], "entity_id long, embedding array<float>, text string")
    with pytest.raises(SQL_FAILURES):
        store.append(bad, 2)
    assert store.read(2).count() == 0


def test_smallest_vectors(spark):
    store = VectorStore(spark, shared_path(spark, "store"))
    store.append(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "entity_id long, embedding array<float>"), 3)
    assert S.nearest(store.read(3), [1.0, 2.0, 3.0]).first().score == 0.0


def test_new_database_name_wins():
    assert choose_database("old", "new") == "new"
    assert choose_database("old", "") == "old" and choose_database("", None) is None


def test_repeated_query_ids(spark):
    corpus = spark.createDataFrame([(i, [float(i)], "t") for i in range(5)], "id long, embedding array<float>, text string")
    same = spark.createDataFrame([(1, [0.0]), (1, [0.0])], "query_id int, embedding array<float>")
    assert [r.id for r in BatchSearch(same, k=3).hits(corpus).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="different vectors"):
        BatchSearch(spark.createDataFrame([(1, [0.0]), (1, [2.0])], "query_id int, embedding array<float>"))


def test_queries_without_hits_keep_an_empty_context(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    contexts = spark.createDataFrame([(1, "found")], "query_id int, context string")
    assert sorted(map(tuple, contexts_of_all(queries, contexts, ["query_id"]).collect())) == [(1, "found"), (2, "")]


@pytest.mark.parametrize("strategy", ["fixed", "nltk", "spacy"])
def test_files_become_searchable(spark, tmp_path, strategy):
    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": "Users write tweets. They\ffollow users.\f", "b.txt": "Likes belong to tweets.\f"}.items():
        (tmp_path / "in" / name).write_text(text)
    store = VectorStore(spark, str(tmp_path / "store"))
    models = M.hashing_models(16)
    files = read_document_files(spark, str(tmp_path / "in"))
    paths = upload_files(store, files, form_feed_pages, models, "text-embedding-3-small", 20, 16, strategy, "docs")
    assert [(r.path.rsplit("/", 1)[1], r.doc_id) for r in paths.orderBy("doc_id").collect()] == [("a.txt", 1), ("b.txt", 2)]
    stored = store.read(16).orderBy("doc_id", "entity_id").collect()
    whole = "Users write tweets. They\nfollow users.\n"
    expected = {
        "fixed": [whole[:20], whole[20:]],
        "nltk": ["Users write tweets.", "They\nfollow users."],
        "spacy": ["Users write tweets.", "They", "follow users."],
    }
    assert [r.text for r in stored if r.doc_id == 1] == expected[strategy]
    queries = spark.createDataFrame([(1, [float(x) for x in stored[-1].embedding])], "query_id int, embedding array<float>")
    assert BatchSearch(queries, k=1).hits(store.read(16)).first()["id"] == stored[-1].id

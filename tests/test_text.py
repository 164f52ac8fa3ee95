import random

import pytest
from pyspark.sql import functions as F

from sqlark.functions.ordered import with_next
from sqlark.operators import text as X
from sqlark.registered.queries import table
from tests.conftest import SMALL_DATA

EDGE_TEXTS = ["", "a", "abcd", "abcdefgh", "éàü𝄞x\ny", "\n\n\n", "no end", "One. Two!  Three?\nFour. ", " . lead"]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chunks_of(df):
    found = {}
    for doc, no, chunk in df.orderBy("doc_id", "entity_id").collect():
        found.setdefault(doc, []).append(chunk)
        assert no == len(found[doc]) - 1
    return found


@pytest.mark.parametrize("size", [1, 4, 256])
def test_fixed_chunks(spark, size):
    found = chunks_of(X.chunk_fixed(documents(spark, EDGE_TEXTS), size))
    for i, whole in enumerate(EDGE_TEXTS):
        assert found.get(i, []) == [whole[j : j + size] for j in range(0, len(whole), size)]


def test_fixed_chunks_give_every_document_back(spark):
    docs = table(spark, SMALL_DATA, "documents").select("doc_id", "text")
    back = X.chunk_fixed(docs, 100).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "text"))), lambda c: c["text"]), "").alias("text")
    )
    assert docs.where("text != ''").exceptAll(back).isEmpty()


def test_sentences(spark):
    found = chunks_of(X.chunk_sentences(documents(spark, EDGE_TEXTS)))
    assert found[7] == ["One.", "Two!", "Three?", "Four."]
    assert found[6] == ["no end"] and 0 not in found
    assert found[4] == ["éàü𝄞x\ny"]


def test_line_sentences(spark):
    found = chunks_of(X.chunk_line_sentences(documents(spark, EDGE_TEXTS)))
    assert found[4] == ["éàü𝄞x", "y"] and 5 not in found
    assert found[7] == ["One.", "Two!", "Three?", "Four."]
    assert found[8] == [".", "lead"]


def test_strategy_by_name(spark):
    docs = documents(spark, ["A b. C d."])
    assert X.chunk(docs, "fixed", 4).count() == 3
    assert X.chunk(docs, "nltk", 4).count() == X.chunk(docs, "spacy", 4).count() == 2
    with pytest.raises(ValueError):
        X.chunk(docs, "words", 4)


def pages(spark, n_docs=4, seed=3):
    rng = random.Random(seed)
    data = []
    for doc in range(n_docs):
        for page in range(rng.randint(1, 9)):
            data.append((doc, page, "".join(rng.choice("abé\n. ") for _ in range(rng.randint(0, 12)))))
    return data, spark.createDataFrame(rng.sample(data, len(data)), "doc_id long, page_no long, text string")


@pytest.mark.parametrize("separator,trailing", [("\n", True), ("", False), ("\n\n", False)])
@pytest.mark.parametrize("per_part", [2, 4096])
def test_page_concatenation(spark, separator, trailing, per_part):
    data, df = pages(spark)
    parts = X.concat_pages(df, separator=separator, trailing=trailing, pages_per_part=per_part).orderBy("doc_id", "part_no")
    found = {}
    for doc, _, text, n_chars in parts.collect():
        assert n_chars == len(text)
        found[doc] = found.get(doc, "") + text
    for doc in {d for d, _, _ in data}:
        texts = [t for d, _, t in sorted(data) if d == doc]
        assert found[doc] == ("".join(t + separator for t in texts) if trailing else separator.join(texts))


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
@pytest.mark.parametrize("per_part", [1, 3, 4096])
def test_chunks_across_parts_equal_chunks_of_the_whole(spark, size, per_part):
    data, df = pages(spark)
    parts = X.concat_pages(df, separator="\n", pages_per_part=per_part)
    found = chunks_of(X.chunk_pages_fixed(parts, size))
    for doc in {d for d, _, _ in data}:
        whole = "".join(t + "\n" for d, _, t in sorted(data) if d == doc)
        assert found.get(doc, []) == [whole[j : j + size] for j in range(0, len(whole), size)]


def test_document_with_most_pages_is_split(spark):
    """One document holds nearly all pages: no part, and so no task, holds them all."""
    hot = spark.range(5000).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.lit("page").alias("text"))
    parts = X.concat_pages(hot, separator=" ", pages_per_part=500)
    assert parts.count() == 10
    assert parts.agg(F.max(F.length("text"))).first()[0] == 500 * 5
    assert X.chunk_pages_fixed(parts, 64).agg(F.sum(F.length("text"))).first()[0] == 5000 * 5


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_next_value_across_blocks_and_gaps(spark, block):
    data = [(1, 0, "a"), (1, 1, None), (1, 5, "c"), (1, 6, "d"), (2, 3, "x")]
    df = spark.createDataFrame(data, "k int, o long, v string")
    assert sorted(map(tuple, with_next(df, ["k"], "o", "v", "after", block).collect()), key=str) == sorted(
        [(1, 0, "a", None), (1, 1, None, "c"), (1, 5, "c", "d"), (1, 6, "d", None), (2, 3, "x", None)], key=str
    )


def test_page_numbers_do_not_split_a_document(spark):
    pages = spark.createDataFrame([(1, 1023, "a."), (1, 1024, "b."), (2, 5000, "c.")], "doc_id int, page_no int, text string")
    parts = X.concat_pages(pages, separator=" ", trailing=False).orderBy("doc_id").collect()
    assert [(r.doc_id, r.part_no, r.text) for r in parts] == [(1, 0, "a. b."), (2, 0, "c.")]


def test_pages_without_number_or_document(spark):
    data = [(1, 0, "a"), (1, 1, "b"), (None, 0, "c"), (None, 1, "d"), (2, None, "e"), (2, 0, "f"), (3, 0, None), (3, 7, "g"), (4, 2, "h"), (4, 2, "h")]
    pages = spark.createDataFrame(data, "doc_id long, page_no long, text string")
    for per_part in (1, 2, 1024):
        parts = X.concat_pages(pages, separator="|", pages_per_part=per_part).orderBy("doc_id", "part_no").collect()
        found = {}
        for r in parts:
            found[r.doc_id] = found.get(r.doc_id, "") + r.text
            assert r.n_chars == len(r.text)
        assert found == {1: "a|b|", None: "c|d|", 2: "e|f|", 3: "g|", 4: "h|h|"}
        chunks = chunks_of(X.chunk_pages_fixed(X.concat_pages(pages, separator="|", pages_per_part=per_part), 3))
        assert chunks[None] == ["c|d", "|"]
    assert X.concat_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("separator", ["", "\n", " "])
@pytest.mark.parametrize("per_part", [1, 2, 5])
def test_sentences_of_pages_equal_those_of_the_whole(spark, separator, per_part):
    rng = random.Random(per_part)
    data = []
    for doc in range(60):
        alphabet = rng.choice(["ab. \n", "a.!? \t", "\n", "a\n", ". ", "abc"])
        for page in range(rng.randint(1, 12)):
            data.append((doc if doc else None, page, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 9])))))
    pages = spark.createDataFrame(data, "doc_id long, page_no long, text string")
    parts = X.concat_pages(pages, separator=separator, trailing=False, pages_per_part=per_part)
    whole = {}
    for doc, _, t in data:
        whole.setdefault(doc, []).append(t)
    joined = spark.createDataFrame([(d, separator.join(ts)) for d, ts in whole.items()], "doc_id long, text string")
    for strategy in X.SENTENCE_RULES:
        assert chunks_of(X.chunk_pages(parts, strategy, 0)) == chunks_of(X.chunk(joined, strategy, 0))
    with pytest.raises(ValueError):
        X.chunk_pages(parts, "words", 4)


def test_sentences_of_a_document_with_most_pages_are_many_tasks(spark):
    hot = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.concat(F.lit("One two. Three"), "id").alias("text"))
    parts = X.concat_pages(hot, separator=" ", trailing=False, pages_per_part=100)
    found = X.chunk_pages_sentences(parts, "nltk")
    assert found.count() == 20_001 and found.agg(F.max("entity_id")).first()[0] == 20_000
    assert found.where("entity_id = 7").first().text == "Three6 One two."
    assert parts.agg(F.max(F.length("text"))).first()[0] < 3000

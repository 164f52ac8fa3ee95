"""Benchmark passages in training documents, by a positional inverted index.

Test items are cut into windows of consecutive words. Training postings,
(term, document, positions), are stored for the terms by which windows are
sought: each window's rarest ones in the corpus. From the rarest on, lists are
joined with positions moved by the term's offset in the window, so that a list
holds the places where the window may start; each further term thins them out.
What is left is compared with the document word by word. With a ``slop``,
offset-adjusted positions may differ by so many words: proximity matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlark.llm.common import map_texts, slices, words_of
from sqlark.session import materialize

WINDOW = 13
#: Terms of a window that are sought before its words are compared.
SOUGHT = 3
#: Terms sent to every task at once; a larger vocabulary takes several passes.
TERMS_AT_ONCE = 500_000
KEY = ["__id", "__hash"]


def test_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``window_id``, ``words`` and ``item_ids`` of every different window. An item
    of fewer words is one window, one without words (or null) has none."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [[w.decode("utf-8") for w in words_of(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.list_(pa.string()))], ["item", "words"])

    worded = map_texts(
        items.select(F.col(item_id).alias("item"), F.col(text).alias("text")), "text", f"item {kind}, words array<string>", run
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    cut = worded.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("item_ids")).select(
        F.monotonically_increasing_id().alias("window_id"), "words", "item_ids"
    )


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("text"))


def _vocabularies(words: DataFrame) -> Iterator[list[str]]:
    """The distinct words in lists of bounded length."""
    words = materialize(words.distinct(), "terms")
    parts = -(-words.count() // TERMS_AT_ONCE) or 1
    for part in range(parts):
        yield [r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(2 * parts)).isin(2 * part, 2 * part + 1)).collect()]


def term_counts(docs: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: how often each of ``words`` occurs in all documents (if it does)."""
    source = docs.select(F.col(text).alias("text"))
    found = None
    for terms in _vocabularies(words):
        known = {t.encode("utf-8"): t for t in terms}

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in slices(batches, "text"):
                for t in batch.column("text").to_pylist():
                    total.update(map(known.get, words_of(t)))
            total.pop(None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )

        part = source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        found = part if found is None else found.union(part)
    return found


def sought_terms(windows: DataFrame, counts: DataFrame, sought: int = SOUGHT) -> DataFrame:
    """For each window its rarest places, ``terms`` as an array of ``(n, word,
    offset)``, rarest first. Windows with a word that no document has are left out."""
    placed = windows.select("window_id", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    joined = placed.join(counts, "word").groupBy("window_id", "length").agg(
        F.sort_array(F.collect_list(F.struct("n", "word", "offset"))).alias("terms")
    )
    return joined.where(F.size("terms") == F.col("length")).select(
        "window_id", "length", F.slice("terms", 1, sought).alias("terms")
    )


def store_postings(docs: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table with one row for each document and vocabulary pass: its
    key, ``n_words``, and ``postings``, an array of ``(word, positions)``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    found = None
    for terms in _vocabularies(words):
        known = {t.encode("utf-8") for t in terms}

        def run(batch: pa.RecordBatch, known=known) -> pa.RecordBatch:
            sizes, postings = [], []
            for t in batch.column("text").to_pylist():
                words = words_of(t)
                sizes.append(len(words))
                places: dict[bytes, list[int]] = {}
                for i, w in enumerate(words):
                    if w in known:
                        places.setdefault(w, []).append(i)
                postings.append([{"word": w.decode("utf-8"), "positions": p} for w, p in places.items()])
            kind = pa.list_(pa.struct([("word", pa.string()), ("positions", pa.list_(pa.int32()))]))
            return pa.RecordBatch.from_arrays(
                [*batch.select(KEY).columns, pa.array(sizes, pa.int64()), pa.array(postings, kind)],
                [*KEY, "n_words", "postings"],
            )

        schema = f"__id {kind}, __hash bigint, n_words bigint, postings array<struct<word:string,positions:array<int>>>"
        part = map_texts(_documents(docs, doc_id, text), "text", schema, run).withColumn("first_pass", F.lit(found is None))
        found = part if found is None else found.union(part)
    return materialize(found, "postings")


def places(postings: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """Key, ``window_id`` and ``start`` wherever all sought terms of a window
    stand at their offsets, up to ``slop`` words off."""
    lists = (
        postings.where(F.size("postings") > 0)
        .select(*KEY, "n_words", F.explode("postings").alias("p"))
        .select(*KEY, "n_words", F.col("p.word").alias("word"), F.col("p.positions").alias("positions"))
    )
    rarest = terms.select("window_id", "length", "terms", F.get("terms", F.lit(0)).alias("t"))
    found = (
        lists.join(rarest, F.col("word") == F.col("t.word"))
        .select(*KEY, "n_words", "window_id", "length", "terms", F.explode(F.transform("positions", lambda p: p - F.col("t.offset"))).alias("start"))
        .where((F.col("start") >= -slop) & (F.col("start") + F.col("length") <= F.col("n_words") + slop))
        .drop("n_words")
        .distinct()
    )
    # offsets of the window's other sought terms; all windows have as many as terms allow
    for i in range(1, SOUGHT):
        term = F.get("terms", F.lit(i))
        due = found.where(F.size("terms") > i).select("*", term["word"].alias("__word"), (F.col("start") + term["offset"]).alias("__due"))
        held = lists.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("word").alias("__held"), "positions")
        same = (F.col("__word") == F.col("__held")) & F.col("_" + KEY[0]).eqNullSafe(F.col(KEY[0])) & F.col("_" + KEY[1]).eqNullSafe(F.col(KEY[1]))
        hit = F.exists("positions", lambda p: F.abs(p - F.col("__due")) <= slop)
        found = (
            due.join(held, same)
            .where(hit)
            .select(*found.columns)
            .distinct()
            .union(found.where(F.size("terms") <= i))
        )
    return found.select(*KEY, "window_id", "start")


def _search(docs: DataFrame, items: DataFrame, doc_id: str, text: str, window: int, slop: int):
    windows = materialize(test_windows(items, window=window), "windows")
    counts = materialize(term_counts(docs, windows.select(F.explode("words").alias("word")), doc_id, text), "term-counts")
    terms = materialize(sought_terms(windows, counts), "sought-terms")
    postings = store_postings(docs, terms.select(F.explode("terms.word").alias("word")), doc_id, text)
    return windows, postings, places(postings, terms, slop)


def proximity_matches(
    docs: DataFrame, items: DataFrame, slop: int, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``doc_id``, ``item_id`` and ``start`` where the rarest words of a window of
    the item stand in their order of offsets, each at most ``slop`` words off."""
    windows, _, found = _search(docs, items, doc_id, text, window, slop)
    return (
        found.join(windows, "window_id")
        .select(F.col(KEY[0]).alias("doc_id"), F.explode("item_ids").alias("item_id"), "start")
        .distinct()
    )


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """For every row ``doc_id``, ``n_words``, ``n_hit`` (words inside an exact
    occurrence of a window), ``item_ids`` (whose windows occur, as sorted
    strings) and ``contaminated`` (at least a twentieth of the words is hit).

    Null texts and texts without words have no words and no hits. Repeated rows
    get equal results. Items of equal id count once; a null item id is never
    listed. No items leave everything clean. Other columns are not read.
    """
    windows, postings, found = _search(docs, items, doc_id, text, window, 0)
    grouped = (
        found.join(windows.select("window_id", "words"), "window_id")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("start", "window_id", "words")).alias("sought"))
    )
    texts = _documents(docs, doc_id, text)
    same = texts["__id"].eqNullSafe(grouped["__id"]) & (texts["__hash"] == grouped["__hash"])
    joined = texts.join(grouped, same).select(texts["__id"], texts["__hash"], "text", "sought")
    kind = docs.schema[doc_id].dataType.simpleString()

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits, verified = [], []
        for t, sought in zip(batch.column("text").to_pylist(), batch.column("sought").to_pylist()):
            words = [w.decode("utf-8") for w in words_of(t)]
            edges = np.zeros(len(words) + 1, np.int64)
            right = set()
            for s in sought:
                start, end = s["start"], s["start"] + len(s["words"])
                if words[start:end] == s["words"]:
                    edges[start] += 1
                    edges[end] -= 1
                    right.add(s["window_id"])
            hits.append(int((np.cumsum(edges) > 0).sum()))
            verified.append(list(right))
        return pa.RecordBatch.from_arrays(
            [*batch.select(KEY).columns, pa.array(hits, pa.int64()), pa.array(verified, pa.list_(pa.int64()))],
            [*KEY, "n_hit", "window_ids"],
        )

    hit = materialize(
        map_texts(joined, "text", f"__id {kind}, __hash bigint, n_hit bigint, window_ids array<bigint>", compare)
        .where(F.col("n_hit") > 0)
        .dropDuplicates(KEY),
        "hits",
    )
    listed = (
        hit.select(*KEY, "n_hit", F.explode("window_ids").alias("window_id"))
        .join(windows.select("window_id", "item_ids"), "window_id")
        .groupBy(*KEY, "n_hit")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))).cast("array<string>")).alias("item_ids"))
        .withColumnsRenamed({k: f"_{k}" for k in KEY})
    )
    sizes = postings.where("first_pass")
    at = F.col("__id").eqNullSafe(F.col("___id")) & F.col("__hash").eqNullSafe(F.col("___hash"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return sizes.join(listed, at, "left").select(
        F.col("__id").alias("doc_id"),
        F.col("__hash").alias("text_hash"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows."""
    bad = (
        contamination(docs, items, doc_id, text)
        .where("contaminated")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .distinct()
    )
    hashed: Column = F.xxhash64(docs[text])
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__id"]) & (hashed == bad["__hash"]), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )

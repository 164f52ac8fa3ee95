"""Ranked lexical search: the best documents of every item by integer impacts.

Method: norm buckets as in LEMP. A document is the vector of sqrt(weight) * impact
over the items' terms, an item that of sqrt(weight) * repeats, and the score their
inner product. Vectors are ordered by length, longest first, and cut into buckets.

1.  One pass over the texts keeps, of every document, its length and how often it
    has each of the items' terms: a stored table. Document frequencies, the number
    of documents and their terms are summed from it.
2.  The table is sorted by the vectors' length (range partitions, so equal lengths
    and copies spread over tasks) and stored again.
3.  The longest vectors are searched first; the k-th best score of each item there
    is its first threshold for all the others, which are searched in parallel.
4.  A bucket whose longest vector times the item's length is below the item's
    threshold is skipped (Cauchy-Schwarz). Inside a bucket, only vectors that have
    one of the item's largest coordinates can reach it, as the other coordinates
    alone cannot. Of these, the sum over those coordinates plus the bound for the
    rest has to reach the threshold. What is left is scored again in integers.

Bounds are widened by a relative 1e-9, far more than doubles lose, so no document is
missed; one that only ties with the threshold stays and competes by its id.
Items are taken in blocks of bounded size, each a pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sqlark.llm.common import map_texts, words_of
from sqlark.session import materialize

BEST = 20
#: Bytes of items' texts in a block; bounds what is broadcast and what the driver holds.
BLOCK_BYTES = 4 << 20
#: Documents in a bucket.
BUCKET = 2048
#: Share of the documents, the longest vectors, that gives the first thresholds.
HEAD = 0.02
SLACK = 1 + 1e-9
#: Sums of doubles are exact below this.
EXACT = 1 << 53
DOCUMENTS, TERMS = -1, -2


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_factor(n: int, documents: int, terms: int) -> int:
    return 100 - 25 + 25 * n * documents // terms


class Items:
    """Items of one block as sparse vectors: plain data that goes to every task."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.counts = [Counter(words_of(r[1])) for r in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}

    def weigh(self, documents: int, frequencies: np.ndarray) -> None:
        """Weights of the terms, and each item's terms from its largest coordinate to its smallest."""
        share = (2 * documents + 2) / (2 * frequencies + 1)
        self.weights = np.floor(1000 * np.log(share)).astype(np.int64)
        self.terms, self.repeats, self.rests = [], [], []
        for count in self.counts:
            terms = np.array([self.vocabulary[t] for t in count], np.int64)
            repeats = np.array(list(count.values()), np.int64)
            long = np.sqrt(self.weights[terms]) * repeats
            order = np.argsort(-long, kind="stable")
            self.terms.append(terms[order])
            self.repeats.append(repeats[order])
            #: lengths of what is left of the item after its first 0, 1, 2, … terms
            squares = np.append(long[order] ** 2, 0.0)
            self.rests.append(np.sqrt(np.cumsum(squares[::-1])[::-1]))

    def __len__(self) -> int:
        return len(self.ids)


def vectors(docs: DataFrame, items: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` terms, and ``terms`` and ``tfs`` (32-bit numbers as bytes) of
    every document that has a term at all, as a stored table."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = items.value.vocabulary
        sizes, terms, tfs = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            found = Counter(map(known.get, words))
            found.pop(None, None)
            sizes.append(len(words))
            terms.append(np.fromiter(found, np.int32, len(found)).tobytes())
            tfs.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
        out = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
            ["doc_id", "n", "terms", "tfs"],
        )
        return out.filter(pa.array([n > 0 for n in sizes]))

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return materialize(map_texts(source, "text", f"doc_id {kind}, n bigint, terms binary, tfs binary", run), "term-vectors")


def statistics(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Number of documents, of all their terms, and the document frequency of each
    of the ``size`` terms of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, documents, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            terms += sum(batch.column("n").to_pylist())
            seen += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([DOCUMENTS, TERMS, *at.tolist()]), pa.array([documents, terms, *seen[at].tolist()])], ["at", "n"]
        )

    # one row for each term of the block
    summed = found.select("n", "terms").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    totals = {r["at"]: r["n"] for r in summed}
    frequencies = np.zeros(size, np.int64)
    for at, n in totals.items():
        if at >= 0:
            frequencies[at] = n
    return totals.get(DOCUMENTS, 0), totals.get(TERMS, 0), frequencies


class _Bucket:
    """Vectors of some documents, by document and by term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, terms: int):
        self.ids = batch.column("doc_id")
        rows = [np.frombuffer(t, np.int32) for t in batch.column("terms").to_pylist()]
        sizes = np.array([len(r) for r in rows], np.int64)
        factor = np.array([length_factor(n, documents, terms) for n in batch.column("n").to_pylist()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        tfs = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), np.int32).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.impacts = impact(tfs, factor[self.owner])
        self.long = np.sqrt(weights[self.terms]) * self.impacts
        self.squares = np.bincount(self.owner, self.long**2, minlength=len(rows))

    def by_term(self) -> None:
        order = np.argsort(self.terms, kind="stable")
        ordered = self.terms[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        self.lists = {int(ordered[a]): order[a:b] for a, b in zip(heads, np.append(heads[1:], len(ordered)))}

    def survivors(self, terms: np.ndarray, long: np.ndarray, rests: np.ndarray, threshold: float) -> np.ndarray:
        """Documents whose score with an item can reach the threshold."""
        if rests[0] * math.sqrt(self.squares.max(initial=0.0)) * SLACK < threshold:
            return np.zeros(0, np.int64)
        # the first terms, so many that the rest alone cannot reach the threshold
        focus = int(np.searchsorted(-(rests * math.sqrt(self.squares.max()) * SLACK), -threshold, side="right"))
        focus = min(focus, len(terms))
        lists = [(self.lists[t], x) for t, x in zip(terms[:focus].tolist(), long[:focus].tolist()) if t in self.lists]
        if not lists:
            return np.zeros(0, np.int64)
        at = np.concatenate([places for places, _ in lists])
        coordinate = np.repeat([x for _, x in lists], [len(places) for places, _ in lists])
        have = self.long[at]
        partial = np.bincount(self.owner[at], coordinate * have, minlength=len(self.squares))
        known = np.bincount(self.owner[at], have * have, minlength=len(self.squares))
        rest = np.sqrt(np.maximum(self.squares - known, 0.0) + 1e-9 * self.squares)
        return np.flatnonzero((partial > 0) & ((partial + rests[focus] * rest) * SLACK >= threshold))

    def scores(self, documents: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the documents; ``weights`` has weight * repeats of every term of the item."""
        sizes = self.starts[documents + 1] - self.starts[documents]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[documents], sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], ends - sizes)


def with_length(found: DataFrame, items: Broadcast, documents: int, terms: int) -> DataFrame:
    """The vectors with a positive ``length``, longest first, as a stored table."""
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n bigint, terms binary, tfs binary, length double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.sqrt(_Bucket(batch, items.value.weights, documents, terms).squares)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], [*batch.schema.names, "length"])

    sized = found.mapInArrow(run, schema).where(F.col("length") > 0)
    # copies have equal lengths: ids and lists spread them over range partitions
    spread = sized.repartitionByRange(F.desc("length"), F.xxhash64("doc_id", "terms"))
    return materialize(spread.sortWithinPartitions(F.desc("length")), "by-length")


def search(vectors: DataFrame, items: Broadcast, thresholds: Broadcast, documents: int, terms: int, best: int) -> DataFrame:
    """``item``, ``score`` and ``doc_id``: of every task and item the ``best``
    documents that reach the item's threshold."""
    kind = vectors.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        held: list[list[tuple]] = [[] for _ in range(len(block))]
        least = np.array(thresholds.value, np.float64)
        weights = np.zeros(len(block.weights), np.int64)
        longs = [np.sqrt(block.weights[t]) * r for t, r in zip(block.terms, block.repeats)]
        key = lambda x: (-x[0], x[1] is None, x[1])
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                bucket = _Bucket(batch.slice(start, BUCKET), block.weights, documents, terms)
                bucket.by_term()
                for i in range(len(block)):
                    close = bucket.survivors(block.terms[i], longs[i], block.rests[i], least[i])
                    if not len(close):
                        continue
                    weights[block.terms[i]] = block.weights[block.terms[i]] * block.repeats[i]
                    scores = bucket.scores(close, weights)
                    weights[block.terms[i]] = 0
                    reach = (scores > 0) & (scores >= least[i])
                    if not reach.any():
                        continue
                    ids = bucket.ids.take(pa.array(close[reach])).to_pylist()
                    held[i] = sorted([*held[i], *zip(scores[reach].tolist(), ids)], key=key)[:best]
                    if len(held[i]) == best:
                        # rounded down, as a double may lie above the integer
                        least[i] = max(least[i], np.nextafter(float(held[i][-1][0]), 0.0))
        found = [(i, *x) for i, rows in enumerate(held) for x in rows]
        if found:
            at, scores, ids = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, to_arrow_type(kind))],
                ["item", "score", "doc_id"],
            )

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(
        run, f"item int, score bigint, doc_id {kind.simpleString()}"
    )


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _rank_block(docs: DataFrame, rows: list[tuple], id_type, best: int, doc_id: str, text: str) -> DataFrame:
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    items = Items(rows)
    found = vectors(docs, context.broadcast(items), doc_id, text)
    documents, terms, frequencies = statistics(found, len(items.vocabulary))
    items.weigh(documents, frequencies)
    shared = context.broadcast(items)
    ordered = with_length(found, shared, documents, terms)
    cut = ordered.approxQuantile("length", [1 - HEAD], HEAD / 10)
    thresholds = np.zeros(len(items))
    if cut:
        first = search(ordered.where(F.col("length") >= cut[0]), shared, context.broadcast(thresholds), documents, terms, best)
        # one row for each item of the block
        for r in _ranked(first, best).where(F.col("rank") == best).select("item", "score").collect():
            thresholds[r["item"]] = np.nextafter(float(r["score"]), 0.0)
    hits = search(ordered, shared, context.broadcast(thresholds), documents, terms, best)
    # the rows of the block, of bounded size
    names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {id_type}")
    return _ranked(hits, best).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(
    docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``best`` documents of
    every row of ``items`` with a score above 0, equal scores by ascending id (nulls last).

    Terms are runs of letters, digits and other non-ASCII characters, A-Z in lower
    case. A null or empty text has none: such a document counts nowhere and such an
    item has no result. Every row counts for itself, so documents that repeat an id
    may stand side by side, and items that repeat one have a list each. Columns of
    ``items`` other than ``item_id`` and ``text`` and of ``docs`` other than id and
    text are not read.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col("text").alias("text")).where(F.length("text") > 0)
    id_type = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [
        _rank_block(docs, [tuple(r) for r in asked.where(place == b).collect()], id_type, best, doc_id, text) for b in range(blocks)
    ]
    return reduce(DataFrame.union, parts)

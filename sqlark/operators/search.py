"""Exact Euclidean search, for one query vector and for whole query tables.

The search is exact, so every query meets every vector of its database. What
is kept small is what moves: no (query, vector) pair becomes a row. Each task
streams its share of the corpus past a bounded tile of queries and emits at
most k rows per query; those few rows are all that is shuffled.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sqlark.constants import ALL_DATABASES, TOP_K
from sqlark.functions.nearest import QuerySet, matrix_of
from sqlark.functions.pivots import Pivots
from sqlark.functions.vectors import euclidean_to, rank_key
from sqlark.session import materialize

MAX_QUERY_BYTES = 64 << 20
CELL_BYTES = 128 << 20
MAX_BROADCAST_ROWS = 1_000_000
#: The sample of the corpus that goes to every task, and how many of its rows are pivots.
SAMPLE_ROWS, SAMPLE_BYTES, PIVOTS = 16_384, 32 << 20, 1024
#: The cell of rows without a vector, or with one of another dimension than the queries.
NO_CELL = -1


def of_database(vectors: DataFrame, database: str | None, column: str = "database") -> DataFrame:
    """Rows of one database; ``None`` and ``All`` mean no filter. On a stored
    vector table the filter prunes partitions."""
    if database is None or database == ALL_DATABASES:
        return vectors
    return vectors.where(F.col(column) == database)


def nearest(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = TOP_K,
    database: str | None = None,
    ids: Sequence[str] = ("id",),
    keep: Sequence[str] = ("embedding", "text"),
    embedding: str = "embedding",
    score: str | None = "score",
) -> DataFrame:
    """The k nearest vectors of one query: ``ids, keep, score``, nearest first.

    NULL vectors come last. Equal scores are ordered by id.
    """
    scored = of_database(vectors, database).withColumn("_score", euclidean_to(embedding, query))
    best = scored.orderBy(rank_key(F.col("_score")).asc_nulls_last(), *ids).limit(k)
    return best.select(*ids, *keep, *([F.col("_score").alias(score)] if score else []))


def _hit_schema(queries: DataFrame, corpus: DataFrame, own: Sequence[str], ids: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(c, queries.schema[c].dataType) for c in own]
        + [T.StructField(i, T.LongType()) for i in ids]
        + [T.StructField("score", T.DoubleType())]
    )


#: Rows of a corpus as they are stored, to batches of rows with the group they are searched in.
Grouping = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def _against_broadcast(
    queries: DataFrame, corpus: DataFrame, schema: T.StructType, embedding: str, by: str | None, k: int, ids: list[str], grouping: Grouping
) -> DataFrame:
    """All queries fit one tile set: send it to every task, leave the corpus where it is."""
    context = corpus.sparkSession.sparkContext
    shared = context.broadcast(queries.toArrow())
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = QuerySet(shared.value, embedding, by, k, ids)
        for batch in batches:
            for rows in grouping(batch):
                search.add(rows)
        yield from search.result(arrow_schema)

    return corpus.mapInArrow(run, schema)


def _meet(
    left: DataFrame, right: DataFrame, keys: list[str], own: list[str], schema: T.StructType, embedding: str, by: str | None, k: int, ids: list[str]
) -> DataFrame:
    """Best rows of every tile of queries among the corpus rows with the same keys."""
    arrow_schema = to_arrow_schema(schema)

    def run(tile: pa.Table, cell: pa.Table) -> pa.Table:
        if tile.num_rows == 0 or cell.num_rows == 0:
            return arrow_schema.empty_table()
        search = QuerySet(tile.select(own), embedding, by, k, ids)
        search.add(cell)
        return pa.Table.from_batches(search.result(arrow_schema), arrow_schema)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _grouped(corpus: DataFrame, by: str, grouping: Grouping) -> DataFrame:
    """The corpus with the groups its rows are searched in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (rows for batch in batches for rows in grouping(batch))

    return corpus.mapInArrow(run, T.StructType([*corpus.schema.fields, T.StructField(by, T.StringType())]))


def grid_sides(
    queries: DataFrame, corpus: DataFrame, embedding: str, ids: list[str], tiles: int, cells: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides split by hash of their unique ids: every tile of queries meets
    every cell of the corpus once. Tile and cell sizes are bounded, whatever the data."""
    query_key = [F.col(c) for c in queries.columns if c != embedding]
    left = queries.withColumn("_tile", F.pmod(F.xxhash64(*query_key), F.lit(tiles))).withColumn(
        "_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    )
    right = corpus.withColumn("_cell", F.pmod(F.xxhash64(*ids), F.lit(cells)).cast("int")).withColumn(
        "_tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))
    )
    return left, right


def pivot_sides(
    queries: DataFrame,
    corpus: DataFrame,
    embedding: str,
    by: str | None,
    k: int,
    ids: list[str],
    dim: int,
    tile_bytes: int,
    cell_bytes: int,
    pivots: int = PIVOTS,
    sample_bytes: int = SAMPLE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Both sides by the corpus's cells: a row stands in the cell of its nearest
    pivot, a query in each cell that can hold one of its k best, ties included.

    A bounded sample of the corpus gives the pivots and an upper bound of each
    query's k-th distance. Cells with many rows are split by hash, and so are their
    queries; every split of the one meets every split of the other. Rows without a
    vector have a cell of their own, for queries that may have fewer than k others.
    """
    spark = corpus.sparkSession
    fits = F.size(embedding) == dim
    rows = max(1, min(SAMPLE_ROWS, sample_bytes // (8 * max(dim, 1))))
    held = corpus.where(F.col(embedding).isNotNull() & fits).orderBy(F.xxhash64(*ids), *ids).limit(rows).toArrow()
    vectors, _ = matrix_of(held.column(embedding), dim)
    found = Pivots(vectors, held.column(by).to_pylist() if by else [None] * held.num_rows, min(pivots, held.num_rows))
    shared = spark.sparkContext.broadcast(found)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(embedding)
            right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
            cell, distance = np.full(batch.num_rows, NO_CELL, np.int32), np.zeros(batch.num_rows)
            at = np.flatnonzero(np.asarray(right))
            if len(at) and shared.value.n:
                cell[at], distance[at] = shared.value.cells(matrix_of(column.take(pa.array(at)), dim)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], [*batch.schema.names, "_cell", "_far"])

    extended = T.StructType([*corpus.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    placed = materialize(corpus.mapInArrow(place, extended), "placed-vectors")
    # one row for each pivot
    shells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_far").alias("least"), F.max("_far").alias("most")).collect()
    shells = {r["_cell"]: r for r in shells}
    cells = np.array(sorted(c for c in shells if c != NO_CELL), np.int32)
    least, most = (np.array([shells[c][name] for c in cells.tolist()]) for name in ("least", "most"))
    groups = by

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, _ = matrix_of(batch.column(embedding), dim)
            reach = shared.value.reach(asked, batch.column(groups).to_pylist() if groups else [None] * batch.num_rows, k)
            seen = shared.value.visits(asked, reach, cells, least, most) if shared.value.n else [cells] * len(asked)
            lists = [[*c.tolist(), NO_CELL] if np.isinf(r) else c.tolist() for c, r in zip(seen, reach)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "_cells"])

    extended = T.StructType([*queries.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    asked = materialize(queries.mapInArrow(visit, extended), "placed-queries")
    # one row for each pivot again
    wanted = asked.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()
    row_bytes = 8 * max(dim, 1)
    splits = [
        (r["_cell"], math.ceil(r["n"] * row_bytes / tile_bytes), math.ceil(shells[r["_cell"]]["n"] * row_bytes / cell_bytes))
        for r in wanted
        if r["_cell"] in shells
    ]
    split = F.broadcast(spark.createDataFrame(splits, "_cell int, _tiles int, _parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - F.lit(1).cast("bigint")))
    query_key = [F.col(c) for c in queries.columns if c != embedding]
    left = (
        asked.select(*queries.columns, F.explode("_cells").alias("_cell"))
        .join(split, "_cell")
        .select(*queries.columns, "_cell", F.pmod(F.xxhash64(*query_key), F.col("_tiles")).alias("_tile"), each("_parts").alias("_part"))
    )
    right = placed.join(split, "_cell").select(
        *corpus.columns, "_cell", each("_tiles").alias("_tile"), F.pmod(F.xxhash64(*ids), F.col("_parts")).alias("_part")
    )
    return left, right


class BatchSearch:
    """Top-k of every query in one job.

    ``by`` confines each query to corpus rows with the same value of that
    column (a database, or a configuration). The query table is written once
    to the shared folder, so an embedder behind it runs once and its size is
    known before anything is broadcast. Beyond ``max_query_bytes`` queries meet the
    cells of the corpus that can hold their neighbours; queries of several
    dimensions, which have no distances to common pivots, meet all of it.
    """

    def __init__(
        self,
        queries: DataFrame,
        k: int = TOP_K,
        query_id: str = "query_id",
        embedding: str = "embedding",
        by: str | None = None,
        max_query_bytes: int = MAX_QUERY_BYTES,
        cell_bytes: int = CELL_BYTES,
    ):
        self.own = [query_id] + ([by] if by else [])
        self.k, self.query_id, self.embedding, self.by = k, query_id, embedding, by
        self.max_query_bytes, self.cell_bytes = max_query_bytes, cell_bytes
        wanted = queries.where(F.col(embedding).isNotNull()).select(*self.own, embedding).distinct()
        self.queries = materialize(wanted, "queries")
        if not self.queries.groupBy(*self.own).count().where("count > 1").isEmpty():
            raise ValueError("a query id stands for different vectors")
        sizes = self.queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(embedding)).alias("dim"), F.min(F.size(embedding)).alias("least")).first()
        self.n_queries, self.dim = sizes["n"], sizes["dim"] or 0
        self.one_dim = self.dim == sizes["least"]

    def within(self, groups: Sequence[str]) -> BatchSearch:
        """The search of these values of ``by`` alone, for a corpus that has no others."""
        narrowed = copy.copy(self)
        narrowed.queries = self.queries.where(F.col(self.by).isin(list(groups)))
        return narrowed

    def _candidates(self, corpus: DataFrame, ids: list[str], grouping: Grouping | None) -> DataFrame:
        columns = [*ids, self.embedding] + ([self.by] if self.by and not grouping else [])
        corpus = corpus.select(*columns)
        schema = _hit_schema(self.queries, corpus, self.own, ids)
        # In memory a query entry is a double.
        query_bytes = self.n_queries * max(self.dim, 1) * 8
        if query_bytes <= self.max_query_bytes:
            as_stored = lambda batch: iter([batch])
            return _against_broadcast(self.queries, corpus, schema, self.embedding, self.by, self.k, ids, grouping or as_stored)
        if grouping:
            corpus = _grouped(corpus, self.by, grouping)
        if self.one_dim:
            sides = pivot_sides(
                self.queries, corpus, self.embedding, self.by, self.k, ids, self.dim, self.max_query_bytes, self.cell_bytes
            )
            keys = ["_cell", "_tile", "_part"]
        else:
            tiles = math.ceil(query_bytes / self.max_query_bytes)
            cells = max(1, math.ceil(corpus.count() * self.dim * 8 / self.cell_bytes))
            sides = grid_sides(self.queries, corpus, self.embedding, ids, tiles, cells)
            keys = ["_tile", "_cell"]
        return _meet(*sides, keys, self.queries.columns, schema, self.embedding, self.by, self.k, ids)

    def hits(self, corpus: DataFrame, ids: Sequence[str] = ("id",), grouping: Grouping | None = None) -> DataFrame:
        """``query_id, [by], rank, ids, score``; rank 1 is the nearest.

        With ``grouping`` the corpus has no column ``by``: the tasks that search it
        put its rows into their groups, ``ids, embedding, by``, so that a row of
        several groups is read and moved once.
        """
        ids = list(ids)
        order = [rank_key(F.col("score")).asc_nulls_last(), *ids]
        ranked = Window.partitionBy(*self.own).orderBy(*order)
        return (
            self._candidates(corpus, ids, grouping)
            .withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= self.k)
            .select(*self.own, "rank", *ids, "score")
        )

    def hits_with_text(
        self, corpus: DataFrame, texts: DataFrame, ids: Sequence[str] = ("id",), text: str = "text"
    ) -> DataFrame:
        """Hits with the text of each row, fetched by id after the search.

        Ids and distances alone go through the search. There are at most
        k rows per query; that count decides whether they are broadcast to the
        scan of the texts.
        """
        hits = self.hits(corpus, ids)
        if self.n_queries * self.k <= MAX_BROADCAST_ROWS:
            hits = F.broadcast(hits)
        keys = [*ids] + ([self.by] if self.by else [])
        return texts.select(*keys, text).join(hits, keys).select(*self.own, "rank", *ids, text, "score")


def _by_rank(fields: Column) -> Column:
    """Rows of one query in rank order; there are at most k of them."""
    return F.array_sort(F.collect_list(fields))


def nested_results(hits: DataFrame, query_id: Sequence[str] | str = "query_id", id: str = "id", text: str = "text") -> DataFrame:
    """One row per query: array of (id, content, score), nearest first."""
    keys = [query_id] if isinstance(query_id, str) else list(query_id)
    entry = F.struct("rank", F.col(id).alias("id"), F.col(text).alias("content"), "score")
    return hits.groupBy(*keys).agg(
        F.transform(_by_rank(entry), lambda e: F.struct(e["id"].alias("id"), e["content"].alias("content"), e["score"].alias("score"))).alias("results")
    )


def assemble_context(hits: DataFrame, query_id: Sequence[str] | str = "query_id", text: str = "text") -> DataFrame:
    """One row per query: retrieved texts joined by a space in rank order."""
    keys = [query_id] if isinstance(query_id, str) else list(query_id)
    entry = F.struct("rank", F.col(text).alias("t"))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(_by_rank(entry), lambda e: e["t"]), " ").alias("context"))


def contexts_of_all(queries: DataFrame, contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, context`` of every query; the context of one without a hit is empty."""
    asked = queries.select(*keys).distinct()
    return asked.join(contexts, [*keys], "left").select(*keys, F.coalesce("context", F.lit("")).alias("context"))


def prompt(table: Column | str, question: Column | str, context: Column | str) -> Column:
    """Prompt text for one question."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    # Fixed value: the wording of the prompt.
    return F.concat(
        F.lit("\n            Based on the embeddings in "),
        as_column(table),
        F.lit(", generate the SQL query to answer: "),
        as_column(question),
        F.lit(".\n            Please provide only the SQL code enclosed within ```sql...``` characters.\n            Context: "),
        as_column(context),
        F.lit("\n            "),
    )


def with_database_suffix(task: Column | str, database: Column | str) -> Column:
    """The task, followed by the name of its database when there is one."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    task, database = as_column(task), as_column(database)
    # Fixed value: the wording of the suffix.
    return F.when(
        F.coalesce(database, F.lit("")) != "", F.concat(task, F.lit("\n\nThe database is "), database)
    ).otherwise(task)

"""Nearest neighbours by inner product: a forest of random-projection trees.

Every tree halves the space at hyperplanes half-way between two vectors drawn
from the node's part of a bounded sample; so that the largest inner product is
the smallest distance, vectors get one more entry that makes all norms equal.
Every vector of the table is put into its leaf of every tree. A query walks all
trees at once by one priority queue, ordered by how far the query is on the
right side of the hyperplanes on the way (the least of them), and takes leaves until they hold
enough vectors. The vectors in these leaves are compared exactly. Many leaves of
a tree are compared in one task, which hands on each query's best vectors only.

Equal vectors are one *point* with its lowest ids, as many as a result can hold;
queries of one vector share their search. So neither copies nor a common vector
grow a leaf or repeat work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlark.llm.common import share_object
from sqlark.session import materialize

NEIGHBOURS = 20
TREES = 16
#: Vectors from which the trees are made, and their bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: Vectors of a leaf, about. The depth of a tree is that of a tree of the sample whose leaves hold eight, at most.
LEAF = 16
#: A query takes leaves until they hold, over all trees, so many vectors for each one of the table. Recall is a matter
#: of this share. SHARE sees nearly every vector even where vectors have no structure that a hyperplane could use, at
#: several products for each of them, as trees hold the same ones. LEAN makes fewer products than a search through all
#: and finds nine tenths of the nearest of such vectors; where vectors form clusters a tenth of it does.
SHARE, LEAN = 5.0, 0.95
#: Points of a node from which its hyperplane is made.
MEANS_SAMPLE = 256
#: Neighbouring leaves of a tree are compared with their queries in one task; so many leaves, vectors and queries at most.
REGION, BLOCK, QUERIES = 1024, 65_536, 4096
#: Candidates that a task holds before it keeps the best of each query, and pairs whose products it makes at once.
HELD, PAIRS = 1 << 19, 1 << 15
#: Products of matrices are right to this share of the vectors' lengths.
ROUNDING = 1e-12


def two_means(points: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Centres of two clusters of the points, from two random ones."""
    centres = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(rounds):
        near = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([points[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in (0, 1)])
    return centres


class Forest:
    """Trees as arrays; children of node i are 2 i + 1 and 2 i + 2, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, norm: float, trees: int = TREES, seed: int = 11):
        self.depth, self.norm, self.trees = depth, norm, trees
        points = self.lifted(sample)
        inner = 2**depth - 1
        self.normal = np.zeros((trees, inner, points.shape[1]))
        self.bias = np.zeros((trees, inner))
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            parts = {0: np.arange(len(points))}
            for node in range(inner):
                part = parts.pop(node)
                a, b = two_means(points[rng.permutation(part)[:MEANS_SAMPLE]], rng) if len(part) > 1 else rng.normal(size=(2, points.shape[1]))
                normal = a - b
                if not normal.any():
                    normal = rng.normal(size=points.shape[1])
                normal = normal / np.linalg.norm(normal)
                at = points[part] @ normal
                # the middle of the part, so that leaves are of about one size
                bias = float(np.median(at)) if len(part) else 0.0
                self.normal[t, node], self.bias[t, node] = normal, bias
                right = at > bias
                parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.norm**2 - (vectors**2).sum(axis=1))
        return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, tree): the leaf of each vector in each tree."""
        points = self.lifted(vectors)
        out = np.zeros((len(points), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                side = (points * self.normal[t, node]).sum(axis=1) > self.bias[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, queries: np.ndarray, sizes: np.ndarray, candidates: int) -> list[list[tuple[int, int]]]:
        """For each query the (tree, leaf) that it visits; ``sizes`` has the vectors in each leaf of each tree."""
        scale = self.norm / np.maximum(np.linalg.norm(queries, axis=1), 1e-300)
        points = np.concatenate([queries * scale[:, None], np.zeros((len(queries), 1))], axis=1)
        inner = 2**self.depth - 1
        found = []
        for point in points:
            margins = np.einsum("tnd,d->tn", self.normal, point) - self.bias
            queue = [(-np.inf, t, 0) for t in range(self.trees)]
            taken, held = [], 0
            while queue and held < candidates:
                worst, t, node = heapq.heappop(queue)
                if node >= inner:
                    taken.append((t, node - inner))
                    held += sizes[t, node - inner]
                    continue
                margin = margins[t, node]
                heapq.heappush(queue, (max(worst, margin), t, 2 * node + 1))
                heapq.heappush(queue, (max(worst, -margin), t, 2 * node + 2))
            found.append(taken)
        return found


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id`` and ``v`` of the rows that take part."""
    v = F.col(embedding)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.where(F.col(vec_id).isNotNull() & v.isNotNull())
        .where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
        .select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    )


def _stack(column: pa.Array) -> np.ndarray:
    """The vectors of a column without nulls, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up one after the other."""
    return np.cumsum(q * v, axis=1)[:, -1]


class Best:
    """The best candidates of each query, ties to the lower id. ``bar`` is what a candidate has to reach."""

    def __init__(self, queries: int, most: int):
        self.most, self.bar = most, np.full(queries, -np.inf)
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, point: np.ndarray, low: np.ndarray, score: np.ndarray) -> None:
        self.parts.append([query, point, low, score])
        self.size += len(query)
        if self.size > HELD:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        query, point, low, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((low, -score, query))
        query, point, low, score = query[order], point[order], low[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        full = rank == self.most - 1
        self.bar[query[full]] = score[full]
        kept = rank < self.most
        self.parts = [[query[kept], point[kept], low[kept], score[kept]]]
        self.size = int(kept.sum())
        return self.parts[0]


def best_in_leaves(
    queries: np.ndarray, visited: list[np.ndarray], points: np.ndarray, lows: np.ndarray, leaves: np.ndarray, vectors: np.ndarray, most: int
) -> list[np.ndarray]:
    """Query number, point, low id and score of the ``most`` best points in the leaves that each query visits."""
    found = Best(len(queries), most)
    slack = ROUNDING * np.linalg.norm(queries, axis=1) * np.sqrt((vectors**2).sum(axis=1).max(initial=0.0))
    order = np.argsort(leaves, kind="stable")
    trip_leaf = np.concatenate(visited) if visited else np.zeros(0, np.int64)
    trip_query = np.repeat(np.arange(len(queries)), [len(v) for v in visited])
    trips = np.argsort(trip_leaf, kind="stable")
    trip_leaf, trip_query = trip_leaf[trips], trip_query[trips]
    for leaf in np.unique(trip_leaf):
        own = order[slice(*np.searchsorted(leaves[order], [leaf, leaf + 1]))]
        asking = trip_query[slice(*np.searchsorted(trip_leaf, [leaf, leaf + 1]))]
        if not len(own):
            continue
        step = max(1, HELD // len(own))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            about = queries[some] @ vectors[own].T
            bar = found.bar[some]
            if len(own) > most:
                bar = np.maximum(bar, np.partition(about, len(own) - most, axis=1)[:, len(own) - most])
            row, place = np.nonzero(about >= (bar - 2 * slack[some])[:, None])
            for first in range(0, len(row), PAIRS):
                part = slice(first, first + PAIRS)
                query, at_point = some[row[part]], own[place[part]]
                score = products(queries[query], vectors[at_point])
                reach = score >= found.bar[query]
                found.add(query[reach], points[at_point[reach]], lows[at_point[reach]], score[reach])
    return found.cut()


def nearest(
    vectors: DataFrame, every: int, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", share: float = SHARE
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found
    for each row whose id is divisible by ``every``.

    Nearest is the largest inner product in double precision, ties go to the
    smaller id. A row is no neighbour of its own id. Rows with a null id, and
    vectors that are null, zero or hold a null or a non-finite number, take no
    part; vectors of different length never meet, and those of each length have a
    forest of their own. Rows that repeat id and vector count once. An empty
    table gives no rows. Other columns are not read.
    """
    rows = usable(vectors, vec_id, embedding)
    # one row for each length that the table mixes
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    parts = [_nearest_of_length(rows.where(F.size("v") == n), n, every, k, share) for n in lengths or [1]]
    return reduce(DataFrame.union, parts)


def _nearest_of_length(rows: DataFrame, length: int, every: int, k: int, share: float) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.distinct()
    # of equal vectors only the lowest k + 1 ids can be in a result
    low = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = materialize(
        low.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
            F.monotonically_increasing_id().alias("point"), "v", "ids", F.get("ids", F.lit(0)).alias("low")
        ),
        "points",
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total, norm = points.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    # bounded by SAMPLE vectors and SAMPLE_BYTES
    drawn = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
    sample = np.array([r.v for r in points.orderBy(F.xxhash64("v"), "point").limit(drawn).select("v").collect()]).reshape(-1, length)
    depth = int(np.clip(np.ceil(np.log2(max(total, 1) / LEAF)), 1, max(1, np.log2(max(len(sample), 1) / 8))))
    forest = Forest(sample, depth, norm or 1.0)
    shared = share_object(spark, forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared().leaves(_stack(batch.column("v")))
            codes = leaves + np.arange(leaves.shape[1]) * 2**depth
            yield pa.RecordBatch.from_arrays(
                [batch.column("point"), pa.array(codes.tolist(), pa.list_(pa.int64()))], ["point", "leaves"]
            )

    placed = materialize(points.select("point", "v").mapInArrow(place, "point bigint, leaves array<bigint>"), "leaves")
    # one row for each leaf of the forest: TREES * 2 ** depth at most
    counts = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
    sizes = np.zeros(TREES * 2**depth, np.int64)
    for r in counts:
        sizes[r["leaf"]] = r["count"]
    wanted = int(share * total)
    #: leaves of a region: a tree has whole regions
    per = min(REGION, 2**depth)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and region that it visits its leaves there."""
        trees = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = trees.search(_stack(part.column("v")), sizes.reshape(TREES, -1), wanted)
                names, regions, lists = [], [], []
                for name, visited in zip(part.column("point").to_pylist(), found):
                    codes = np.sort(np.array([t * 2**depth + leaf for t, leaf in visited], np.int64))
                    cuts = np.flatnonzero(np.diff(codes // per)) + 1
                    for piece in np.split(codes, cuts) if len(codes) else []:
                        names.append(name)
                        regions.append(int(piece[0] // per))
                        lists.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(regions, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["point", "region", "leaves"],
                )

    asking = rows.where(F.col("id") % every == 0).join(points.select("v", "point"), "v").select("id", "point")
    asking = materialize(asking, "queries")
    queries = materialize(points.join(asking.select("point").distinct(), "point").select("point", "v"), "query-points")
    trips = materialize(queries.mapInArrow(walk, "point bigint, region bigint, leaves array<bigint>"), "visits")
    # regions of leaves in blocks of bounded size, and so their queries; each block of one meets each block of the other
    homes = placed.select("point", F.explode("leaves").alias("leaf")).withColumn("region", F.floor(F.col("leaf") / per))
    blocks = (
        homes.groupBy("region")
        .agg(F.count(F.lit(1)).alias("held"))
        .join(trips.groupBy("region").agg(F.count(F.lit(1)).alias("asked")), "region")
        .select("region", F.ceil(F.col("held") / BLOCK).alias("parts"), F.ceil(F.col("asked") / QUERIES).alias("turns"))
    )
    salt = lambda n: F.pmod(F.xxhash64("point"), F.col(n))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = (
        homes.join(blocks, "region")
        .select("region", salt("parts").alias("part"), every_one("turns").alias("turn"), "leaf", "point")
        .join(points.select("point", "low", "v"), "point")
    )
    asks = (
        trips.join(blocks, "region")
        .select("region", every_one("parts").alias("part"), salt("turns").alias("turn"), "leaves", "point")
        .join(queries, "point")
        .select(*[F.col(c).alias(f"q_{c}") for c in ("region", "part", "turn", "leaves", "point", "v")])
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best points of each query within the region."""
        schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("low", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        names = left["q_point"].to_numpy()
        query, point, low, score = best_in_leaves(
            _stack(left["q_v"].combine_chunks()),
            [np.array(x, np.int64) for x in left["q_leaves"].to_pylist()],
            right["point"].to_numpy(),
            right["low"].to_numpy(),
            right["leaf"].to_numpy(),
            _stack(right["v"].combine_chunks()),
            k + 1,
        )
        return pa.table([names[query], point, low, score], schema=schema)

    keys = ["region", "part", "turn"]
    found = asks.groupBy(*[f"q_{c}" for c in keys]).cogroup(held.groupBy(*keys)).applyInArrow(
        compare, "query bigint, point bigint, low bigint, score double"
    )
    # a point comes from several leaves; then the best points of each query with their ids
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    top = found.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    listed = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    each = (
        listed.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
        .where(F.col("r") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("hits"))
    )
    own = F.filter("hits", lambda h: h["vec_id"] != F.col("id"))
    return (
        asking.join(each, F.col("point") == F.col("query"))
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("at", "hit"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            F.col("hit.score").alias("score"),
        )
    )

"""Arrow kernel of the batch nearest-neighbour join.

Runs inside tasks on one slice of the corpus and one bounded tile of queries;
Spark decides which slices and tiles meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS_PER_STEP = 4096
QUERIES_PER_STEP = 1024
PAIRS_PER_STEP = 1 << 16


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the non-null vectors of a list column, and the mask of those rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = ~np.asarray(column.is_null())
    kept = column.filter(pa.array(present)) if not present.all() else column
    lengths = np.unique(np.asarray(kept.value_lengths()))
    if len(lengths) > 1 or (dim is not None and len(lengths) and lengths[0] != dim):
        raise ValueError(f"different vector dimensions: expected {dim}, found {lengths.tolist()}")
    width = int(lengths[0]) if len(lengths) else (dim or 0)
    flat = np.asarray(kept.flatten(), dtype=np.float64)
    if np.isnan(flat).any():
        raise ValueError("NULL or NaN inside a vector")
    return flat.reshape(len(kept), width), present


def _first_per_query(query: np.ndarray, rank: np.ndarray, ids: list[np.ndarray], k: int) -> np.ndarray:
    """Positions of the k best (rank, ids) entries of each query."""
    order = np.lexsort((*reversed(ids), rank, query))
    sorted_query = query[order]
    starts = np.r_[True, sorted_query[1:] != sorted_query[:-1]]
    position = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[position < k]


def _drop_surplus_copies(vectors: np.ndarray, ids: list[np.ndarray], k: int) -> np.ndarray:
    """Of equal vectors only the k lowest ids can be among the k nearest."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    return np.sort(_first_per_query(group.ravel(), np.zeros(len(group)), ids, k))


class Tile:
    """At most ``QUERIES_PER_STEP`` queries and, while corpus rows stream past, their k best rows."""

    def __init__(self, queries: np.ndarray, k: int, n_ids: int):
        self.queries, self.k = queries, k
        self.norms = (queries * queries).sum(axis=1)
        self.bound = np.full(len(queries), np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.distance = np.empty(0)
        self.ids = [np.empty(0, dtype=np.int64) for _ in range(n_ids)]

    def add(self, vectors: np.ndarray, ids: list[np.ndarray]) -> None:
        for start in range(0, len(vectors), ROWS_PER_STEP):
            rows = slice(start, start + ROWS_PER_STEP)
            self._step(vectors[rows], [i[rows] for i in ids])

    def add_missing(self, ids: list[np.ndarray]) -> None:
        """Rows without a vector: infinitely far, so they rank last, by id."""
        few = _first_per_query(np.zeros(len(ids[0])), np.zeros(len(ids[0])), ids, self.k)
        n, m = len(self.queries), len(few)
        self._keep(np.repeat(np.arange(n), m), np.full(n * m, np.inf), [np.tile(i[few], n) for i in ids])

    def _step(self, vectors: np.ndarray, ids: list[np.ndarray]) -> None:
        norms = (vectors * vectors).sum(axis=1)
        squares = self.norms[:, None] + norms[None, :] - 2.0 * (self.queries @ vectors.T)
        # Rounding error of the expanded square; what lies within it is measured directly below.
        slack = 1e-13 * float(self.norms.max(initial=0.0) + norms.max(initial=0.0))
        near = squares <= self._limit(squares, slack)[:, None]
        if self._crowded(near):
            kept = _drop_surplus_copies(vectors, ids, self.k)
            vectors, ids, near = vectors[kept], [i[kept] for i in ids], near[:, kept]
        query, row = np.nonzero(near)
        for start in range(0, len(query), PAIRS_PER_STEP):
            part = slice(start, start + PAIRS_PER_STEP)
            gaps = self.queries[query[part]] - vectors[row[part]]
            self._keep(query[part], np.sqrt((gaps * gaps).sum(axis=1)), [i[row[part]] for i in ids])

    def _crowded(self, near: np.ndarray) -> bool:
        return np.count_nonzero(near) > 8 * self.k * len(self.queries)

    def _limit(self, squares: np.ndarray, slack: float) -> np.ndarray:
        """Largest square that may still rank, ties in single precision included."""
        bound = self.bound
        if squares.shape[1] >= self.k and self._crowded(squares <= bound[:, None]):
            bound = np.minimum(bound, np.partition(squares, self.k - 1, axis=1)[:, self.k - 1] + slack)
        return np.maximum(bound, 0.0) * (1.0 + 1e-6) + 2.0 * slack

    def _keep(self, query: np.ndarray, distance: np.ndarray, ids: list[np.ndarray]) -> None:
        query = np.concatenate([self.query, query])
        distance = np.concatenate([self.distance, distance])
        ids = [np.concatenate([old, new]) for old, new in zip(self.ids, ids)]
        best = _first_per_query(query, distance.astype(np.float32), ids, self.k)
        self.query, self.distance, self.ids = query[best], distance[best], [i[best] for i in ids]
        counts = np.bincount(self.query, minlength=len(self.queries))
        last = np.cumsum(counts)[counts == self.k] - 1
        self.bound[counts == self.k] = self.distance[last] ** 2


class QuerySet:
    """Queries of one tile set, by group value when searches are confined to a group."""

    def __init__(self, queries: pa.Table, embedding: str, by: str | None, k: int, id_names: list[str]):
        self.queries, self.by, self.embedding, self.id_names = queries, by, embedding, id_names
        self.tiles: dict[object, list[tuple[np.ndarray, Tile]]] = {}
        column = queries.column(embedding).combine_chunks()
        for group, rows in self._groups(queries.column(by) if by else None, queries.num_rows):
            for start in range(0, len(rows), QUERIES_PER_STEP):
                part = rows[start : start + QUERIES_PER_STEP]
                vectors, present = matrix_of(column.take(pa.array(part)))
                if len(vectors):
                    self.tiles.setdefault(group, []).append((part[present], Tile(vectors, k, len(id_names))))

    @staticmethod
    def _groups(column: pa.Array | pa.ChunkedArray | None, n: int) -> Iterator[tuple[object, np.ndarray]]:
        if column is None:
            yield None, np.arange(n)
            return
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        encoded = column.dictionary_encode()
        codes = np.asarray(encoded.indices.fill_null(-1))
        for code, value in enumerate(encoded.dictionary.to_pylist()):
            yield value, np.nonzero(codes == code)[0]

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        if batch.num_rows == 0:
            return
        ids = [np.asarray(batch.column(name), dtype=np.int64) for name in self.id_names]
        for group, rows in self._groups(batch.column(self.by) if self.by else None, batch.num_rows):
            if group not in self.tiles:
                continue
            dim = self.tiles[group][0][1].queries.shape[1]
            column = batch.column(self.embedding)
            vectors, present = matrix_of(column.take(pa.array(rows)) if len(rows) < batch.num_rows else column, dim)
            for _, tile in self.tiles[group]:
                tile.add(vectors, [i[rows][present] for i in ids])
                if not present.all():
                    tile.add_missing([i[rows][~present] for i in ids])

    def result(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Best rows: the query's own columns, then ids, then distance (NULL: no vector)."""
        for parts in self.tiles.values():
            for positions, tile in parts:
                own = self.queries.drop_columns([self.embedding]).take(pa.array(positions[tile.query]))
                far = np.isinf(tile.distance)
                columns = [c.combine_chunks() for c in own.columns]
                columns += [pa.array(i) for i in tile.ids]
                columns.append(pa.array(np.where(far, 0.0, tile.distance), mask=far))
                yield from pa.table(columns, schema=schema).to_batches()

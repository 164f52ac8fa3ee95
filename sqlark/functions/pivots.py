"""Cells around pivots, and the cells in which a query's neighbours can lie.

Every vector belongs to the cell of its nearest pivot. With the distances of a
query to the pivots, the triangle inequality bounds how near a cell's vectors can
be; a cell that cannot hold one as near as the k-th best that is already known
need not be looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROWS_PER_STEP = 2048
#: Distances come from expanded squares; bounds are widened by this share of the vectors' lengths.
SLACK = 1e-6


def distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    squares = (vectors * vectors).sum(axis=1)[:, None] + (others * others).sum(axis=1)[None, :] - 2.0 * (vectors @ others.T)
    return np.sqrt(np.maximum(squares, 0.0))


@dataclass
class Pivots:
    """A bounded sample of the corpus: the first ``n`` are pivots, all of them bound
    the k-th best distance of queries of their group."""

    vectors: np.ndarray
    groups: list
    n: int

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot of each vector."""
        cell, distance = np.empty(len(vectors), np.int32), np.empty(len(vectors))
        for start in range(0, len(vectors), ROWS_PER_STEP):
            rows = slice(start, start + ROWS_PER_STEP)
            found = distances(vectors[rows], self.vectors[: self.n])
            cell[rows] = found.argmin(axis=1)
            distance[rows] = found.min(axis=1)
        return cell, distance

    def reach(self, queries: np.ndarray, groups: list, k: int) -> np.ndarray:
        """No more than the k-th best distance of each query; infinite where the sample has fewer of its group."""
        found = np.full(len(queries), np.inf)
        own: dict = {}
        for i, group in enumerate(self.groups):
            own.setdefault(group, []).append(i)
        asked: dict = {}
        for i, group in enumerate(groups):
            asked.setdefault(group, []).append(i)
        for group, rows in asked.items():
            members = own.get(group, [])
            if len(members) >= k:
                for start in range(0, len(rows), ROWS_PER_STEP):
                    part = rows[start : start + ROWS_PER_STEP]
                    found[part] = np.partition(distances(queries[part], self.vectors[members]), k - 1, axis=1)[:, k - 1]
        return found

    def visits(self, queries: np.ndarray, reach: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
        """For each query the cells, out of those that have vectors (at distances
        from ``least`` to ``most`` of their pivots), that can hold one within its reach."""
        out = []
        longest = np.sqrt((self.vectors * self.vectors).sum(axis=1)).max(initial=0.0)
        for start in range(0, len(queries), ROWS_PER_STEP):
            rows = slice(start, start + ROWS_PER_STEP)
            found = distances(queries[rows], self.vectors[: self.n])
            nearest = found.min(axis=1)[:, None]
            found = found[:, cells]
            # outside the cell's shell, or on the far side of the border to the cell of the nearest pivot
            bound = np.maximum(np.maximum(found - most, least - found), (found - nearest) / 2)
            length = np.sqrt((queries[rows] ** 2).sum(axis=1))[:, None]
            slack = SLACK * (length + longest + most)
            near = bound <= reach[rows][:, None] * (1 + SLACK) + slack
            out += [cells[row] for row in near]
        return out

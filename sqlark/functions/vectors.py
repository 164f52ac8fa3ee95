"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 128


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance of two vector columns, summed in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def _balanced_sum(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def euclidean_to(embedding: Column | str, vector: Sequence[float]) -> Column:
    """Distance of a vector column to one given vector.

    Short vectors unroll into plain arithmetic, which is compiled with the
    scan (about four times faster than array functions); long ones would
    outgrow a compiled method and go through array functions.
    """
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    if not vector or len(vector) > UNROLL_LIMIT:
        distance = euclidean(column, F.array(*[F.lit(float(x)) for x in vector]))
    else:
        gaps = [F.get(column, F.lit(i)).cast("double") - F.lit(float(x)) for i, x in enumerate(vector)]
        distance = F.sqrt(_balanced_sum([gap * gap for gap in gaps]))
    mismatch = F.raise_error(F.lit(f"different vector dimensions: expected {len(vector)}"))
    return F.when(F.size(column) == len(vector), distance).when(column.isNotNull(), mismatch.cast("double"))


def rank_key(distance: Column) -> Column:
    """Distances are compared in single precision, the precision vectors are
    stored in, so that equal neighbours do not change places with the order in
    which an engine adds up squares."""
    return distance.cast("float")

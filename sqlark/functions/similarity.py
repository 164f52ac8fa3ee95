"""Text similarity 0..100 from the longest common subsequence."""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence: one pass over the shorter
    text, with one bit per character of the longer one."""
    prefix = len(commonprefix([a, b]))
    a, b = a[prefix:], b[prefix:]
    suffix = len(commonprefix([a[::-1], b[::-1]]))
    if suffix:
        a, b = a[:-suffix], b[:-suffix]
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        matched = row & places.get(char, 0)
        row = ((row + matched) | (row - matched)) & full
    return prefix + suffix + len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    # Only non-empty, unequal texts get here; NULL marks the others.
    return pd.Series(
        [
            None if x is None or y is None else round(100 * (2.0 * lcs_length(x, y) / (len(x) + len(y))))
            for x, y in zip(a, b)
        ],
        dtype="Int32",
    )


def similarity(a: Column | str, b: Column | str) -> Column:
    """100 for equal texts, 0 for a NULL or one empty side, else the rounded
    share of characters in the longest common subsequence. Whole texts."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    unclear = a.isNotNull() & b.isNotNull() & (a != b) & (a != "") & (b != "")
    ratio = _lcs_ratio(F.when(unclear, a), F.when(unclear, b))
    return F.when(a == b, 100).when(unclear, ratio).otherwise(0).cast("int")


def register_similarity(spark: SparkSession, name: str = "lcs_ratio") -> None:
    """Make the ratio of two non-empty texts callable from SQL."""
    spark.udf.register(name, _lcs_ratio)

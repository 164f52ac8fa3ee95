"""Lines that many documents share are dropped.

Method: lines are exploded as hashes of their normalised form, distinct
documents are counted per hash, lines over the threshold are dropped and the
others are joined again in order. Only DataFrame functions.

A line's text never leaves its document: hashes, ids and line numbers are
shuffled, and each document gets back the numbers of the lines it loses. A
line is known by 128 bits of hash. Distinct (line, document) pairs are made
before lines are counted, so no line is a hot key; the join that follows is
left to adaptive execution, which splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
MIN_POINTS = 20
MIN_DOCUMENTS = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    trimmed = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, UPPER.lower()))


def second_half(line: Column) -> Column:
    """64 bits beside ``xxhash64(line)``: the salt comes first, as a later one would hash the first half only."""
    return F.xxhash64(F.lit(1), line)


def drop_shared_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_points: int = MIN_POINTS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``docs`` with ``text`` replaced, plus ``n_lines`` and ``n_dropped``.

    A key of at least ``min_points`` code points that occurs in at least
    ``min_documents`` documents loses all its lines, except those in the
    largest ``doc_id`` holding it, where all of them stay. Rows of one
    ``doc_id`` are one document. A null text is one empty line and becomes
    empty. Rows with a null id count together as one document, lower than any
    other. Existing columns ``n_lines`` and ``n_dropped`` are replaced; all
    others stay.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    source = docs.select(*own)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    #: equal rows of one document lose the same lines
    row = {"__id": F.col(doc_id), "__text_hash": F.xxhash64(text)}
    exploded = (
        source.select(*[c.alias(k) for k, c in row.items()], F.posexplode(lines).alias("__at", "__line"))
        .where(F.char_length("__line") >= min_points)
        .withColumn("__line", line_key(F.col("__line")))
        .where(F.char_length("__line") >= min_points)
        .select(*row, "__at", F.xxhash64("__line").alias("__a"), second_half(F.col("__line")).alias("__b"))
    )
    shared = (
        exploded.select("__a", "__b", "__id")
        .distinct()
        .groupBy("__a", "__b")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__last"))
        .where(F.col("__n") >= min_documents)
    )
    lost = (
        exploded.join(shared, ["__a", "__b"])
        .where(~F.col("__id").eqNullSafe(F.col("__last")))
        .groupBy(*row)
        .agg(F.collect_set("__at").alias("__lost"))
    )
    joined = source.join(
        lost, row["__id"].eqNullSafe(lost["__id"]) & row["__text_hash"].eqNullSafe(lost["__text_hash"]), "left"
    ).withColumn("__lines", lines)
    numbers = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_except(numbers, "__lost"), lambda i: F.get("__lines", i))
    result = {
        text: F.when(F.col("__lost").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long"),
    }
    return joined.select(*[result.get(c, F.col(c)).alias(c) for c in own], *[result[c].alias(c) for c in ("n_lines", "n_dropped")])

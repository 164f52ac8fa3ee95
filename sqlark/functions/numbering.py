"""Dense numbers 1..n over a whole table without passing it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlark.session import materialize

POSITION = "_position"
_PARTITION_SHIFT = 33


def with_position(df: DataFrame) -> DataFrame:
    """Position key of each row: partition number, then place in the partition.
    It changes from run to run, so it must be written before it is used."""
    return df.withColumn(POSITION, F.monotonically_increasing_id())


def number_positions(stored: DataFrame, name: str) -> DataFrame:
    """Turn stored position keys into dense numbers 1..n.

    Rows are counted per partition; the running total of those counts has one
    row per partition, so it is small enough to broadcast by construction.
    """
    partition = F.shiftright(F.col(POSITION), _PARTITION_SHIFT)
    counts = stored.groupBy(partition.alias("_partition")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col(POSITION).bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        stored.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(name, F.col("_offset") + place + 1)
        .drop("_partition", "_offset", POSITION)
    )


def number_rows(df: DataFrame, name: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Dense numbers 1..n, in the given order when there is one.

    Equal rows are told apart by where they were read, so that a value shared
    by a large part of the rows still splits over many range partitions.
    """
    if order_by:
        df = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order_by, "_tie").drop("_tie")
    return number_positions(materialize(with_position(df), "numbered"), name)

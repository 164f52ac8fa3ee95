"""Ordered work inside groups of any size.

One document or conversation may hold a third of all rows, so nothing here
sorts or gathers a whole group in one task. Every group is cut into blocks of
consecutive order values; blocks are the unit of shuffling, and only one small
summary row per block is looked at across a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4096


def block_of(order: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """Block number of an integer order column, e.g. page or turn number."""
    return F.floor(F.col(order) / rows_per_block).cast("bigint")


def with_running_offset(blocks: DataFrame, keys: Sequence[str], size: Column, offset: str, total: str) -> DataFrame:
    """Per block: total size of the group's earlier blocks, and of the whole group.

    The window runs over a table of one narrow row per block. Keys may be null:
    in the join they are fields of a struct, which equal each other then.
    """
    narrow = blocks.select(F.struct(*keys, "block").alias("_at"), size.alias("_size"))
    whole = Window.partitionBy(*[F.col("_at")[k] for k in keys])
    before = whole.orderBy(F.col("_at")["block"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.select(
        "_at",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias(offset),
        F.sum("_size").over(whole).alias(total),
    )
    return blocks.withColumn("_at", F.struct(*keys, "block")).join(offsets, "_at").drop("_at")


def with_next(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """``value`` of the following row of the group, NULL on the last row.

    Inside a block by a window; across a block border from the first row of
    the next block that has rows.
    """
    rows = df.withColumn("_block", block_of(order, rows_per_block))
    heads = rows.groupBy(*keys, "_block").agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("_head"))
    following = Window.partitionBy(*keys).orderBy("_block")
    heads = heads.select(*keys, "_block", F.lead("_head").over(following).alias("_next_head"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    linked = rows.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(inside)).join(
        heads, [*keys, "_block"], "left"
    )
    return linked.select(*df.columns, F.coalesce("_next", "_next_head")["v"].alias(name))

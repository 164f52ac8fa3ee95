"""Insert with defaults: serial ids and the current time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlark.functions.numbering import number_rows
from sqlark.sources.catalog import with_created_default


def with_serial_ids(existing: DataFrame, new_rows: DataFrame, id_column: str, order_by: Sequence[str] = ()) -> DataFrame:
    """New rows with ids that continue after the highest existing one."""
    start = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_start"))
    numbered = number_rows(new_rows.drop(id_column), "_n", order_by)
    return numbered.withColumn(id_column, F.col("_n") + start.scalar()).select(
        id_column, *[c for c in numbered.columns if c != "_n"]
    )


def rows_to_insert(
    existing: DataFrame,
    new_rows: DataFrame,
    id_column: str,
    time_column: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    rows = with_serial_ids(existing, new_rows, id_column, order_by)
    return with_created_default(rows, time_column) if time_column else rows

"""SQL taken out of a model's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlark.constants import LOOSE_SQL_PATTERN, STRICT_SQL_PATTERN

_EDGE_SPACE = r"\A\s+|\s+\z"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def loose_sql(outputs: Column | str) -> Column:
    """Text after the first `` `sql `` up to the next backtick, untrimmed; '' without one."""
    return F.coalesce(F.regexp_extract(outputs, LOOSE_SQL_PATTERN, 1), F.lit(""))


def strict_sql(outputs: Column | str) -> Column:
    """Inside of the first fenced block, without the stop word in any case, trimmed."""
    inside = _strip(F.coalesce(F.regexp_extract(outputs, STRICT_SQL_PATTERN, 1), F.lit("")))
    return _strip(F.regexp_replace(inside, "(?i)terminate", ""))


EXTRACTORS = {"loose": loose_sql, "strict": strict_sql}

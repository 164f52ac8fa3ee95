"""Evaluation table: generated SQL against golden SQL, by text and by result."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.constants import SQL_ERROR
from sqlark.functions.answers import EXTRACTORS
from sqlark.functions.numbering import POSITION, number_positions, with_position
from sqlark.functions.similarity import similarity
from sqlark.operators.results import (
    SQL_FAILURES,
    OutOfTime,
    aligned,
    contains_result,
    error_class,
    execute,
    storable,
    stored_outcome,
    surplus,
)
from sqlark.operators.scoring import coincidence
from sqlark.session import materialize, shared_path
from sqlark.sources.catalog import Databases

CONCURRENT_STATEMENTS = 8
#: What a statement may take if the caller does not say otherwise.
STATEMENT_SECONDS = 3600.0

_SHOWN_SCHEMA = T.StructType(
    [T.StructField("sql", T.StringType()), T.StructField("shown", T.StringType())]
)
_PAIR_SCHEMA = T.StructType(
    [
        T.StructField("expected_sql", T.StringType()),
        T.StructField("generated_sql", T.StringType()),
        T.StructField("equal", T.BooleanType()),
        T.StructField("contained", T.BooleanType()),
    ]
)


@dataclass
class StoredResult:
    """What one SQL text yielded; its rows lie in the shared folder."""

    sql: str
    shown: str
    names: list[str] | None = None
    n_rows: int = 0
    table: DataFrame | None = None
    error: str | None = None

    def rows(self) -> DataFrame:
        return self.table.drop(POSITION).toDF(*self.names)

    def indexed(self) -> DataFrame:
        return number_positions(self.table, "_row")


def run_and_store(
    spark: SparkSession, databases: Databases, database: str, sql: str, seconds: float | None = STATEMENT_SECONDS
) -> StoredResult:
    """Run one SQL text once and keep its rows. Any failure is a result of its own,
    and so is a statement that takes longer than its budget; it leaves nothing running.

    It is shown as its number of rows and a hash of their contents in which
    order does not matter.
    """
    shape = lambda rows: with_position(storable(rows))
    names: list[str] = []

    def shaped(rows: DataFrame) -> DataFrame:
        names.extend(rows.columns)
        return shape(rows)

    outcome = stored_outcome(databases, database, sql, shared_path(spark, "result"), seconds, shaped)
    if outcome.rows is None:
        return StoredResult(sql, SQL_ERROR, error=outcome.error)
    table = outcome.rows
    values = F.to_json(F.struct(*[c for c in table.columns if c != POSITION]), {"ignoreNullFields": "false"})
    digest = F.conv(F.substring(F.md5(values), 1, 15), 16, 10).cast("decimal(38,0)")
    n_rows, total = table.agg(F.count(F.lit(1)), F.sum(digest)).first()
    shown = f"{n_rows} rows {int(total or 0) % (1 << 60):015x}"
    return StoredResult(sql, shown, names, n_rows, table)


def late(result: StoredResult) -> bool:
    return result.error == OutOfTime.__name__


def equal_plans(databases: Databases, database: str, texts: Iterable[str]) -> list[list[tuple[str, list[str]]]]:
    """The texts in groups that one run answers, each with its column names.

    Texts are in a group if their analysed plans are the same up to names and
    spelling. A text that does not analyse is a group of its own.
    """
    groups: dict[int, list[tuple[DataFrame, list]]] = {}
    alone = []
    for text in texts:
        rows = execute(databases, database, text).rows
        if rows is None:
            alone.append([(text, [])])
            continue
        similar = groups.setdefault(rows.semanticHash(), [])
        group = next((members for first, members in similar if first.sameSemantics(rows)), None)
        if group is None:
            similar.append((rows, group := []))
        group.append((text, rows.columns))
    return [members for similar in groups.values() for _, members in similar] + alone


def compare_stored(expected: StoredResult, generated: StoredResult, ordered: bool) -> tuple[bool, bool]:
    """(equal, contained) of two stored results. A failed generated query is neither."""
    if expected.table is None:
        raise ValueError(f"golden SQL fails: {expected.sql}")
    if generated.table is None:
        return False, False
    try:
        return _compare(expected, generated, ordered)
    except SQL_FAILURES as failure:
        error_class(failure)
        return False, False


def _compare(expected: StoredResult, generated: StoredResult, ordered: bool) -> tuple[bool, bool]:
    if expected.n_rows == generated.n_rows:
        if expected.n_rows == 0:
            return True, True
        a, b = (r.indexed() if ordered else r.table.drop(POSITION) for r in (expected, generated))
        pair = aligned(a, b)
        if pair is not None and surplus(*pair).isEmpty():
            return True, True
    return False, contains_result(expected.rows(), generated.rows())


def write_results(stored: Iterable[StoredResult], path: str) -> None:
    """All rows of all results as one table ``(sql, row_no, row_json)``."""
    for result in stored:
        if result.table is not None:
            values = F.struct(*[c for c in result.table.columns if c != POSITION])
            result.table.select(
                F.lit(result.sql).alias("sql"),
                F.col(POSITION).alias("row_no"),
                F.to_json(values, {"ignoreNullFields": "false"}).alias("row_json"),
            ).write.mode("append").parquet(path)


def _stream(df: DataFrame) -> Iterator[tuple]:
    return (tuple(row) for row in df.toLocalIterator())


def score_answers(
    spark: SparkSession,
    rows: DataFrame,
    databases: Databases,
    database: str,
    extraction: str = "loose",
    ordered: bool = False,
    results_path: str | None = None,
    seconds: float | None = STATEMENT_SECONDS,
) -> DataFrame:
    """One row per ``(run_id, question, expected_sql, outputs [, verdict])`` row
    with both SQL texts, both results (row count and hash), similarity and
    coincidence. ``results_path`` gets all rows of all results.

    Texts whose analysed plans are equal run once, several plans at a time; each
    run is a distributed job that writes its own table and ends within ``seconds``
    or fails (``"Error"``); what was late beside others is run once more alone. What comes back to the driver is one summary per
    distinct text and per distinct pair of texts.
    """
    if "verdict" not in rows.columns:
        rows = rows.withColumn("verdict", F.lit(None).cast("string"))
    generated = EXTRACTORS[extraction]("outputs")
    scored = materialize(
        rows.withColumn("generated_sql", generated).withColumn(
            "similarity", similarity("generated_sql", "expected_sql")
        ),
        "answers",
    )
    pairs = list(_stream(scored.select("expected_sql", "generated_sql").distinct()))
    texts = dict.fromkeys(text for pair in pairs for text in pair)
    with ThreadPoolExecutor(CONCURRENT_STATEMENTS) as pool:
        groups = equal_plans(databases, database, texts)
        run = lambda group: run_and_store(spark, databases, database, group[0][0], seconds)
        # one that was late beside others may have waited for them: it gets its budget again, alone
        results = [run(group) if late(r) else r for group, r in zip(groups, list(pool.map(run, groups)))]
        stored = {
            text: replace(result, sql=text, names=names) for group, result in zip(groups, results) for text, names in group
        }
        compared = list(
            pool.map(lambda p: (*p, *compare_stored(stored[p[0]], stored[p[1]], ordered)), pairs)
        )
    if results_path:
        write_results(stored.values(), results_path)
    shown = spark.createDataFrame([(r.sql, r.shown) for r in stored.values()], _SHOWN_SCHEMA)
    verdicts = spark.createDataFrame(compared, _PAIR_SCHEMA)
    as_result = lambda side: shown.select(F.col("sql").alias(f"{side}_sql"), F.col("shown").alias(f"{side}_result"))
    return (
        scored.join(verdicts, ["expected_sql", "generated_sql"])
        .join(as_result("expected"), "expected_sql")
        .join(as_result("generated"), "generated_sql")
        .select(
            "run_id",
            "question",
            "expected_sql",
            "generated_sql",
            "expected_result",
            "generated_result",
            "similarity",
            coincidence(F.col("equal"), F.col("verdict"), F.col("contained")).alias("result_coincidence"),
        )
    )

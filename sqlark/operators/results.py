"""Running SQL on a named database and comparing results."""

from __future__ import annotations

import itertools
import json
import re
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.functions.numbering import number_rows
from sqlark.session import remove_path
from sqlark.sources.catalog import Databases

T_ = TypeVar("T_")
SQL_FAILURES = (PySparkException, Py4JError)
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_VIEW = "org.apache.spark.sql.catalyst.plans.logical.View"
#: Expressions that run code by its name or code of users. All others of Catalyst compute values.
_RUN_CODE = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDAF"}
#: Plan nodes that a query over tables is made of.
_NODES = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit",
    "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "LogicalRDD", "LogicalRelation", "Offset",
    "OneRowRelation", "Project", "Range", "RebalancePartitions", "Repartition", "RepartitionByExpression", "ResolvedHint",
    "ResolvedInlineTable", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "UnionLoop", "UnionLoopRef", "Unpivot",
    "View", "Window", "WithCTE", "WithWindowDefinition",
}
#: Seconds between two attempts to cancel what a statement has started since.
CANCEL_SECONDS = 0.25


class RefusedQuery(Exception):
    """The statement is a query but reaches outside the database."""


class OutOfTime(Exception):
    """The statement took longer than its budget."""


@dataclass
class Outcome:
    """Rows of a query, or the class of its failure."""

    rows: DataFrame | None
    error: str | None = None


def _after(tree: list[dict], at: int) -> int:
    """Where the subtree that begins at a place of a tree in pre-order ends."""
    due = 1
    while due:
        due += tree[at]["num-children"] - 1
        at += 1
    return at


def plan_classes(df: DataFrame) -> tuple[set[str], set[str]]:
    """Classes of the analysed plan's nodes and of its expressions, those of
    subqueries included. What stands behind a view is not the statement's."""
    nodes: set[str] = set()
    expressions: set[str] = set()
    waiting = [json.loads(df._jdf.queryExecution().analyzed().toJSON())]
    while waiting:
        part = waiting.pop()
        if isinstance(part, dict):
            waiting += part.values()
        elif isinstance(part, list) and part and isinstance(part[0], dict) and "num-children" in part[0]:
            at = 0
            while at < len(part):
                kind = part[at]["class"]
                (expressions if kind.startswith(_EXPRESSIONS) else nodes).add(kind)
                waiting += part[at].values()
                at = _after(part, at) if kind == _VIEW else at + 1
        elif isinstance(part, list):
            waiting += part
    return nodes, expressions


def refused_classes(df: DataFrame) -> list[str]:
    """What of the plan is no node of a query over tables, or runs code. Names in
    the text decide nothing, so a column may be called like a function."""
    nodes, expressions = plan_classes(df)
    last = lambda name: name.rpartition(".")[2]
    return sorted({last(n) for n in nodes} - _NODES | {last(e) for e in expressions} & _RUN_CODE)


def query(session: SparkSession, sql: str) -> DataFrame:
    """Rows of a statement that must be a query.

    As a subquery in FROM, commands, inserts and empty text do not parse; the
    analysed plan must consist of allowed nodes and expressions.
    """
    df = session.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
    refused = refused_classes(df)
    if refused:
        raise RefusedQuery(f"not part of a query: {', '.join(refused)}")
    return df


def within(spark: SparkSession, seconds: float | None, work: Callable[[], T_]) -> T_:
    """What ``work`` returns, unless it takes longer than ``seconds``: then all jobs
    that it has started, and starts from then on, are cancelled and ``OutOfTime``
    is raised.

    Jobs are known by a tag of the calling thread, which Spark hands on to the jobs
    of broadcasts and subqueries, so other threads' statements go on. What a
    statement does between its jobs (planning) ends before it can be cancelled.
    """
    if seconds is None:
        return work()
    context = spark.sparkContext
    tag = f"statement-{uuid.uuid4().hex}"
    ended, late = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(seconds):
            return
        late.set()
        while True:
            context.cancelJobsWithTag(tag)
            if ended.wait(CANCEL_SECONDS):
                # a broadcast or subquery may have outlived the job that waited for it
                context.cancelJobsWithTag(tag)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        result = work()
    except SQL_FAILURES as failure:
        if late.is_set():
            raise OutOfTime(f"more than {seconds} seconds") from failure
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
    if late.is_set():
        raise OutOfTime(f"more than {seconds} seconds")
    return result


def execute(databases: Databases, database: str, sql: str) -> Outcome:
    """Analyze a query on a named database. What goes wrong only while rows
    are computed shows when they are first used."""
    try:
        return Outcome(query(databases.session(database), sql or ""))
    except (*SQL_FAILURES, RefusedQuery) as failure:
        return Outcome(None, error_class(failure))


def stored_outcome(
    databases: Databases, database: str, sql: str, path: str, seconds: float | None = None, shape: Callable = lambda df: df
) -> Outcome:
    """Run a statement within its budget and store its rows, in the form that
    ``shape`` gives them, at ``path``. A statement that fails on the way leaves no rows there."""
    found = execute(databases, database, sql)
    if found.rows is None:
        return found
    session = databases.session(database)
    rows = shape(found.rows)
    try:
        within(session, seconds, lambda: rows.write.parquet(path))
    except (*SQL_FAILURES, OutOfTime) as failure:
        error = error_class(failure)
        remove_path(session, path)
        return Outcome(None, error)
    return Outcome(session.read.schema(rows.schema).parquet(path))


def error_class(failure: BaseException) -> str:
    """Spark's name for what is wrong with a statement.

    A failure without one is not the statement's (a lost executor, a full
    disk) and is raised again instead of being scored.
    """
    if isinstance(failure, (RefusedQuery, OutOfTime)):
        return type(failure).__name__
    named = failure.getCondition() if isinstance(failure, PySparkException) else None
    cause = getattr(failure, "java_exception", None)
    while named is None and cause is not None:
        if "getCondition" in dir(cause):
            named = cause.getCondition()
        cause = cause.getCause()
    if named is None:
        raise failure
    return named


def column_names(df: DataFrame, default: str = "Column") -> list[str]:
    """Names of the result's columns; an expression without an alias is ``Column<n>``."""
    aliased = re.compile(r"[^\W\d]\w*\Z")
    return [name if aliased.match(name) else f"{default}{i}" for i, name in enumerate(df.columns, 1)]


def named(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df))


def positional(df: DataFrame, prefix: str = "c") -> DataFrame:
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def storable(df: DataFrame) -> DataFrame:
    """Positional names, and text instead of the typeless NULL, which no file can hold."""
    plain = positional(df)
    return plain.select(
        *[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in plain.schema]
    )


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """Type two columns are compared in; ``None`` when their values never match."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in (a, b)):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b))
            return T.DecimalType(38, scale)
        return T.LongType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampNTZType()
    if isinstance(a, (T.StringType, T.VarcharType, T.CharType)) and isinstance(b, (T.StringType, T.VarcharType, T.CharType)):
        return T.StringType()
    return None


def _hashable(column: Column, kind: T.DataType) -> Column:
    """Maps cannot be grouped on; their JSON text with sorted keys can."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column)))
    return column


def _comparable(name: str, own: T.DataType, kind: T.DataType) -> Column:
    """The column in the type of the comparison. A number that does not fit
    there keeps its text instead, and so differs from every one that fits."""
    value = F.col(name)
    if not isinstance(kind, T.DecimalType):
        return _hashable(value.cast(kind), kind)
    fitting = value.try_cast(kind)
    misfit = F.when(fitting.isNull(), value.cast("string"))
    return F.struct(fitting.alias("fitting"), misfit.alias("misfit"))


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with equal names and types by position, or ``None``."""
    if len(a.columns) != len(b.columns):
        return None
    kinds = [common_type(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema)]
    if any(kind is None for kind in kinds):
        return None

    def cast(df: DataFrame) -> DataFrame:
        plain = positional(df)
        return plain.select(*[_comparable(f"c{i}", plain.schema[i].dataType, kind).alias(f"c{i}") for i, kind in enumerate(kinds)])

    return cast(a), cast(b)


def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose counts differ: ``n`` is positive when ``a`` has more of them.

    Both sides are counted in one aggregation that combines map-side, so a row
    that fills a third of a result travels once per task.
    """
    columns = a.columns
    both = a.withColumn("_n", F.lit(1).cast("bigint")).unionAll(b.withColumn("_n", F.lit(-1).cast("bigint")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("n")).where(F.col("n") != 0)


def with_row_index(df: DataFrame) -> DataFrame:
    """The result's own row order as a column."""
    return number_rows(df, "_row")


def same_result(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Positional equality of two results, row counts included, NULL equal to NULL.

    Unordered unless asked: without ORDER BY a result has no order. Two empty
    results are equal whatever their columns.
    """
    pair = aligned(a, b)
    if pair is None:
        return a.isEmpty() and b.isEmpty()
    left, right = (with_row_index(positional(x)) for x in pair) if ordered else pair
    return surplus(left, right.select(*left.columns)).isEmpty()


def value_class(kind: T.DataType) -> str:
    """Types whose values may be equal have the same class; the typeless NULL has the class of every type."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return kind.simpleString()


def _fingerprint(column: Column, kind: T.DataType) -> Column:
    """A hash that equal values share, whatever types of their class hold them. Others may share it, too."""
    as_class = {"number": "double", "time": "timestamp_ntz", "text": "string"}.get(value_class(kind))
    value = column.cast(as_class) if as_class else _hashable(column, kind)
    if as_class == "double":
        value = value + F.lit(0.0)  # -0.0 is 0.0
    return F.when(column.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(value_class(kind)), value))


def _with_fingerprints(df: DataFrame, prefix: str) -> DataFrame:
    """Fingerprints of a result's columns, numbered."""
    plain = positional(df, "_")
    return plain.select(*[_fingerprint(F.col(f.name), f.dataType).alias(f"{prefix}{i}") for i, f in enumerate(plain.schema)])


def _lacking(expected: DataFrame, generated: DataFrame, left: Sequence[Column], right: Sequence[Column]) -> list[set[int]]:
    """For each hash of ``left`` the hashes of ``right`` under which some value
    occurs less often: one aggregation for all of them together.

    A row gives one entry for each hash of its side, not one for every two of
    them, and a value's entries are at most as many as there are hashes.
    """
    def entries(df: DataFrame, hashes: Sequence[Column], side: int) -> DataFrame:
        marks = F.array(*[F.struct(F.lit(i).alias("at"), h.alias("value")) for i, h in enumerate(hashes)])
        return df.select(F.explode(marks).alias("m")).select(F.lit(side).alias("side"), "m.*")

    both = entries(expected, left, 0).union(entries(generated, right, 1))
    if len(left) * len(right) <= COUNTED_AT_ONCE:
        return _lacking_few(both, len(left), len(right))
    counted = both.groupBy("side", "at", "value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("at", "n")))
    have = F.transform(F.sequence(F.lit(0), F.lit(len(right) - 1)), lambda j: F.coalesce(F.get(F.filter("have", lambda h: h["at"] == j), F.lit(0))["n"], F.lit(0)))
    short = (
        counted.groupBy("value")
        .agg(of(0).alias("need"), of(1).alias("have"))
        .where(F.size("need") > 0)
        .select("need", have.alias("have"))
        .select(F.explode("need").alias("need"), "have")
        .select(F.col("need.at").alias("at"), F.transform("have", lambda n: (n < F.col("need.n")).cast("int")).alias("lacks"))
    )
    # one row for each hash of the left side, columns only
    lost = short.groupBy("at").agg(*[F.max(F.get("lacks", F.lit(j))).alias(f"l{j}") for j in range(len(right))]).collect()
    found: list[set[int]] = [set() for _ in left]
    for row in lost:
        found[row["at"]] = {j for j in range(len(right)) if row[f"l{j}"]}
    return found


#: Pairs of hashes whose counts stand beside each other in one row for each value.
COUNTED_AT_ONCE = 64


def _lacking_few(both: DataFrame, n_left: int, n_right: int) -> list[set[int]]:
    """The same for few hashes: each value's counts are numbers of one row, moved once."""
    n = lambda side, at: F.count_if((F.col("side") == side) & (F.col("at") == at))
    counts = both.groupBy("value").agg(
        *[n(0, i).alias(f"e{i}") for i in range(n_left)], *[n(1, j).alias(f"g{j}") for j in range(n_right)]
    )
    lacks = counts.agg(
        *[F.bool_or(F.col(f"e{i}") > F.col(f"g{j}")).alias(f"l{i}_{j}") for i in range(n_left) for j in range(n_right)]
    ).first()
    return [{j for j in range(n_right) if lacks[f"l{i}_{j}"]} for i in range(n_left)]


def possible_columns(expected: DataFrame, generated: DataFrame) -> list[list[int]]:
    """For each expected column the generated columns that hold all of its values,
    each as often or more. Found by hash; a column that only seems to fit is found
    out when rows are compared."""
    n = len(generated.columns)
    if not n:
        return [[] for _ in expected.columns]
    left, right = _with_fingerprints(expected, "e"), _with_fingerprints(generated, "g")
    lacks = _lacking(left, right, [left[c] for c in left.columns], [right[c] for c in right.columns])
    comparable = lambda a, b: common_type(a.dataType, b.dataType) is not None
    return [
        [j for j, b in enumerate(generated.schema) if comparable(a, b) and j not in lacks[i]] for i, a in enumerate(expected.schema)
    ]


def twins(df: DataFrame, columns: Sequence[int]) -> dict[int, int]:
    """For each of the columns the first of them with the same value in every row."""
    kinds = [f.dataType for f in df.schema]
    pairs = [(i, j) for k, j in enumerate(columns) for i in columns[:k] if kinds[i] == kinds[j]]
    if not pairs:
        return {j: j for j in columns}
    plain = positional(df, "c")
    same = lambda i, j: F.coalesce(
        F.bool_and(_hashable(F.col(f"c{i}"), kinds[i]).eqNullSafe(_hashable(F.col(f"c{j}"), kinds[j]))), F.lit(True)
    )
    row = plain.agg(*[same(i, j).alias(f"p{i}_{j}") for i, j in pairs]).first()
    first = {j: j for j in columns}
    for i, j in pairs:
        if row[f"p{i}_{j}"] and first[i] == i and first[j] == j:
            first[j] = i
    return first


def pairs_that_fit(expected: DataFrame, generated: DataFrame, possible: Sequence[Sequence[int]]) -> dict[tuple[int, int], set[tuple[int, int]]]:
    """For every two expected columns that have a choice, the two generated columns
    that hold all of their value pairs, each as often or more."""
    left, right = _with_fingerprints(expected, "e"), _with_fingerprints(generated, "g")
    wanted = [(i, k) for k in range(len(possible)) for i in range(k) if len(possible[i]) > 1 or len(possible[k]) > 1]
    offered = sorted({(j, m) for i, k in wanted for j in possible[i] for m in possible[k] if j != m})
    if not wanted or not offered:
        return {w: set() for w in wanted}
    both = lambda df, x, y: F.xxhash64(df[df.columns[x]], df[df.columns[y]])
    lacks = _lacking(left, right, [both(left, *w) for w in wanted], [both(right, *o) for o in offered])
    return {
        (i, k): {o for n, o in enumerate(offered) if n not in lacks[w] and o[0] in possible[i] and o[1] in possible[k]}
        for w, (i, k) in enumerate(wanted)
    }


def assignments(
    possible: Sequence[Sequence[int]],
    fitting: Mapping[tuple[int, int], set[tuple[int, int]]] | None = None,
    twin: Mapping[int, int] | None = None,
    twin_expected: Mapping[int, int] | None = None,
) -> Iterator[list[int]]:
    """Every choice of a different column for each expected one.

    The column with the fewest choices left is decided first, and what no longer
    fits beside it (``fitting``, see ``pairs_that_fit``) leaves the others' choices.
    Of equal columns (``twins``) the first free one stands for all, and equal
    expected columns take theirs in order, so that no two choices differ in equal
    columns only.
    """
    fitting, twin, twin_expected = fitting or {}, twin or {}, twin_expected or {}
    alike = lambda i: twin_expected.get(i, i)
    with_twins = {alike(i) for i in twin_expected if alike(i) != i}

    def fits(i: int, j: int, k: int, m: int) -> bool:
        if j == m or (alike(i) == alike(k) and (i < k) != (j < m)):
            return False
        allowed = fitting.get((min(i, k), max(i, k)))
        return allowed is None or ((j, m) if i < k else (m, j)) in allowed

    def extend(chosen: dict[int, int], left: dict[int, list[int]]) -> Iterator[list[int]]:
        if not left:
            yield [chosen[i] for i in range(len(possible))]
            return
        i = min(left, key=lambda x: len(left[x]))
        tried = set()
        for j in sorted(left[i]) if alike(i) in with_twins else left[i]:
            if twin.get(j, j) in tried:
                continue
            tried.add(twin.get(j, j))
            rest = {k: [m for m in ms if fits(i, j, k, m)] for k, ms in left.items() if k != i}
            if all(rest.values()):
                yield from extend({**chosen, i: j}, rest)

    return extend({}, {i: list(js) for i, js in enumerate(possible)})


#: Choices of columns that one job verifies.
CHOICES_AT_ONCE = 16


def _any_holds(expected: DataFrame, generated: DataFrame, choices: Sequence[Sequence[int]]) -> bool:
    """Whether under one of the choices all expected rows are in the generated result, counts included."""
    right = positional(generated, "g")
    short = None
    for n, chosen in enumerate(choices):
        pair = aligned(expected, right.select(*[F.col(f"g{j}") for j in chosen]))
        if pair is None:
            continue
        part = surplus(*pair).where(F.col("n") > 0).limit(1).select(F.lit(n).alias("choice"))
        short = (part, [n]) if short is None else (short[0].union(part), [*short[1], n])
    if short is None:
        return False
    failed = {r["choice"] for r in short[0].distinct().collect()}
    return any(n not in failed for n in short[1])


def contains_result(expected: DataFrame, generated: DataFrame) -> bool:
    """Is all of the expected result, row counts included, in the generated
    one? Extra rows and columns do not matter.

    One job finds the columns that can stand for each expected one. Where there is
    a choice, three more find equal columns and what fits beside each other, and the
    rows are compared under ``CHOICES_AT_ONCE`` remaining choices a job.
    """
    n_expected = expected.count()
    if not n_expected:
        return True
    if generated.count() < n_expected:
        return False
    names = [n.lower() for n in generated.columns]
    # columns of the same name are tried first
    possible = [
        sorted(found, key=lambda j, name=name.lower(): names[j] != name)
        for name, found in zip(expected.columns, possible_columns(expected, generated))
    ]
    if not all(possible):
        return False
    fitting, twin, twin_expected = {}, {}, {}
    if any(len(js) > 1 for js in possible):
        twin = twins(generated, sorted({j for js in possible for j in js}))
        twin_expected = twins(expected, range(len(expected.columns)))
        fitting = pairs_that_fit(expected, generated, possible)
    choices = assignments(possible, fitting, twin, twin_expected)
    while batch := list(itertools.islice(choices, CHOICES_AT_ONCE)):
        if _any_holds(expected, generated, batch):
            return True
    return False

"""Session defaults and the shared folder for durable intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_PARTITION_BYTES = 128 << 20
#: The same for rows that are grouped by nearly unique keys, which take many times their stored size in memory.
GROUPED_BYTES = 16 << 20
UNKNOWN_BYTES = 1 << 60

_local_folders: dict[str, str] = {}
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def build_session(app_name: str = "sqlark", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches and that outlives any of them.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    go without: driver and executors are then one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="sqlark-")
    return _local_folders[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and pins non-deterministic columns
    in a table that survives the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    if _staged.get() is not None:
        _staged.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of tables materialized inside, for a caller that removes them
    when what reads them has been written."""
    paths: list[str] = []
    token = _staged.set(paths)
    try:
        yield paths
    finally:
        _staged.reset(token)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside go when the block ends. For jobs that have
    written their result by then."""
    paths: list[str] = []
    token = _staged.set(paths)
    try:
        yield
    finally:
        _staged.reset(token)
        for path in paths:
            remove_path(spark, path)


def estimated_bytes(df: DataFrame) -> int:
    """Size estimate for choosing a partition count, no bound: the optimizer's, but
    at most what the plan's tables have together, each as often as it is read. For a
    join the optimizer takes the product of both sides, the square of the input. The
    estimate is astronomical for data whose size is unknown."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), read)


def spread(df: DataFrame, *keys: str | Column, target_bytes: int = TARGET_PARTITION_BYTES) -> DataFrame:
    """Hash rows by a unique key over enough tasks for expensive per-row work.

    One shuffle of the input, so that a file or a document holding a large
    share of the rows does not become one long task. Hashing (not round robin)
    keeps the assignment the same when a task is retried.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    if size >= UNKNOWN_BYTES:
        # Nothing is known before it is shuffled: adaptive execution then makes parts of the advisory size.
        return df.hint("rebalance", *columns)
    return df.repartition(max(2 * parallelism, math.ceil(size / target_bytes)), *columns)

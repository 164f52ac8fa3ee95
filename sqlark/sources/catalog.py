"""Named databases of tables, and the social-network schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.session import GROUPED_BYTES, spread

TableBuilder = Callable[[SparkSession], DataFrame]


def _fields(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


_LONG, _TEXT, _TIME = T.LongType(), T.StringType(), T.TimestampNTZType()

SOCIAL_SCHEMAS: dict[str, T.StructType] = {
    "users": _fields(
        ("user_id", _LONG, False),
        ("username", _TEXT, False),
        ("email", _TEXT, False),
        ("password_hash", _TEXT, False),
        ("bio", _TEXT, True),
        ("created_at", _TIME, True),
    ),
    "tweets": _fields(
        ("tweet_id", _LONG, False),
        ("user_id", _LONG, False),
        ("content", _TEXT, False),
        ("created_at", _TIME, True),
    ),
    "follows": _fields(
        ("follower_id", _LONG, False),
        ("followee_id", _LONG, False),
        ("followed_at", _TIME, True),
    ),
    "likes": _fields(
        ("like_id", _LONG, False),
        ("user_id", _LONG, False),
        ("tweet_id", _LONG, False),
        ("liked_at", _TIME, True),
    ),
    "comments": _fields(
        ("comment_id", _LONG, False),
        ("tweet_id", _LONG, False),
        ("user_id", _LONG, False),
        ("content", _TEXT, False),
        ("created_at", _TIME, True),
    ),
}


def open_database(spark: SparkSession, tables: Mapping[str, TableBuilder]) -> SparkSession:
    """A session of its own for one named database, with one view per table.

    It shares the Spark context, so tables of several databases may carry the
    same name without colliding. Files cannot be read by path from its SQL.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    for name, build in tables.items():
        build(session).createOrReplaceTempView(name)
    return session


class Databases:
    """Database name → tables; each database is opened once, on first use."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Mapping[str, TableBuilder]]):
        self._spark = spark
        self._tables = dict(tables)
        self._open: dict[str, SparkSession] = {}

    def names(self) -> list[str]:
        return sorted(self._tables)

    def session(self, database: str) -> SparkSession:
        if database not in self._tables:
            raise KeyError(f"unknown database {database!r}")
        if database not in self._open:
            self._open[database] = open_database(self._spark, self._tables[database])
        return self._open[database]


def parquet_table(path: str, schema: T.StructType | str | None = None) -> TableBuilder:
    """Builder of a table scan; an explicit schema saves the footer read."""

    def build(session: SparkSession) -> DataFrame:
        reader = session.read if schema is None else session.read.schema(schema)
        return reader.parquet(path)

    return build


def social_parquet(root: str) -> dict[str, TableBuilder]:
    """The five social tables stored as ``root/<table>`` with their declared schemas."""
    return {name: parquet_table(f"{root}/{name}", schema) for name, schema in SOCIAL_SCHEMAS.items()}


def with_created_default(df: DataFrame, column: str) -> DataFrame:
    """``TIMESTAMP DEFAULT CURRENT_TIMESTAMP``: a missing time becomes the query's start time."""
    now = F.current_timestamp().cast("timestamp_ntz")
    if column not in df.columns:
        return df.withColumn(column, now)
    return df.withColumn(column, F.coalesce(F.col(column), now))


class Tables(Mapping):
    """Tables of one session, each built when it is first asked for."""

    def __init__(self, session: SparkSession, builders: Mapping[str, TableBuilder]):
        self._session, self._builders = session, builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self._session)
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


# The social schema over an order-entry star schema --------------------------

STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def star_table(sf_dir: str, name: str) -> TableBuilder:
    return parquet_table(f"{sf_dir}/{name}.parquet", STAR_SCHEMAS[name])


def users_view(sf_dir: str) -> TableBuilder:
    def build(session: SparkSession) -> DataFrame:
        return star_table(sf_dir, "customer")(session).select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        )

    return build


def tweets_view(sf_dir: str, priority: str | None = None) -> TableBuilder:
    """Orders as tweets; with ``priority`` only those of that priority."""

    def build(session: SparkSession) -> DataFrame:
        orders = star_table(sf_dir, "orders")(session)
        if priority is not None:
            orders = orders.where(F.col("o_orderpriority") == priority)
        return orders.select(
            F.col("o_orderkey").alias("tweet_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("order "), "o_orderkey", F.lit(" "), "o_orderstatus").alias("content"),
            F.col("o_orderdate").alias("created_at"),
        )

    return build


def follows_view(sf_dir: str) -> TableBuilder:
    def build(session: SparkSession) -> DataFrame:
        orders = star_table(sf_dir, "orders")(session).select("o_orderkey", "o_custkey")
        items = star_table(sf_dir, "lineitem")(session).select("l_orderkey", "l_suppkey")
        pairs = (
            orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
            .where(F.col("o_custkey") != F.col("l_suppkey"))
            .select(F.col("o_custkey").alias("follower_id"), F.col("l_suppkey").alias("followee_id"))
        )
        return spread(pairs, "follower_id", "followee_id", target_bytes=GROUPED_BYTES).distinct()

    return build


def likes_view(sf_dir: str) -> TableBuilder:
    def build(session: SparkSession) -> DataFrame:
        return star_table(sf_dir, "lineitem")(session).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("like_id"),
            F.col("l_partkey").alias("user_id"),
            F.col("l_orderkey").alias("tweet_id"),
            F.col("l_shipdate").alias("liked_at"),
        )

    return build


def comments_view(sf_dir: str) -> TableBuilder:
    def build(session: SparkSession) -> DataFrame:
        return star_table(sf_dir, "events")(session).select(
            F.col("event_id").alias("comment_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("tweet_id"),
            F.col("user_id"),
            F.col("event_type").alias("content"),
            F.col("ts").alias("created_at"),
        )

    return build


def social_views(sf_dir: str) -> dict[str, TableBuilder]:
    return {
        "users": users_view(sf_dir),
        "tweets": tweets_view(sf_dir),
        "follows": follows_view(sf_dir),
        "likes": likes_view(sf_dir),
        "comments": comments_view(sf_dir),
    }


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    merged = counts[0]
    for part in counts[1:]:
        merged = merged.unionAll(part)
    return merged

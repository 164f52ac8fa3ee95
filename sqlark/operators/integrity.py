"""Declared constraints, checked as jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlark.session import GROUPED_BYTES, spread


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (NULL keys never clash in SQL).

    Few of the rows are equal, so they are dealt out before they are counted: a
    task holds the keys of a bounded part, not those of a whole split."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    dealt = spread(present.select(*keys), *keys, target_bytes=GROUPED_BYTES)
    return dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def value_violations(
    df: DataFrame, not_null: Sequence[str] = (), max_length: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows per broken NOT NULL or VARCHAR(n) rule, all rules in one pass."""
    rules = [(f"{c} not null", F.col(c).isNull()) for c in not_null]
    rules += [(f"{c} length {n}", F.length(c) > n) for c, n in (max_length or {}).items()]
    counted = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, broken) in enumerate(rules)])
    as_rows = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_rows")) for i, (name, _) in enumerate(rules)]
    )
    return counted.select(F.inline(as_rows))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str


SOCIAL_FOREIGN_KEYS = (
    ForeignKey("tweets", "user_id", "users", "user_id"),
    ForeignKey("follows", "follower_id", "users", "user_id"),
    ForeignKey("follows", "followee_id", "users", "user_id"),
    ForeignKey("likes", "user_id", "users", "user_id"),
    ForeignKey("likes", "tweet_id", "tweets", "tweet_id"),
    ForeignKey("comments", "tweet_id", "tweets", "tweet_id"),
    ForeignKey("comments", "user_id", "users", "user_id"),
)


@dataclass(frozen=True)
class TableRules:
    """Unique keys (the first one is the primary key), columns that must have a
    value, and the most characters of a text column."""

    keys: tuple[tuple[str, ...], ...]
    not_null: tuple[str, ...]
    max_length: tuple[tuple[str, int], ...] = ()


# The declared constraints of the social schema.
SOCIAL_RULES = {
    "users": TableRules(
        (("user_id",), ("username",), ("email",)),
        ("user_id", "username", "email", "password_hash"),
        (("username", 50), ("email", 100), ("password_hash", 100)),
    ),
    "tweets": TableRules((("tweet_id",),), ("tweet_id", "user_id", "content")),
    "follows": TableRules((("follower_id", "followee_id"),), ("follower_id", "followee_id")),
    "likes": TableRules((("like_id",),), ("like_id", "user_id", "tweet_id")),
    "comments": TableRules((("comment_id",),), ("comment_id", "tweet_id", "user_id", "content")),
}


def rule_violations(tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules] = SOCIAL_RULES) -> DataFrame:
    """``table_name, rule, n_rows``: how often each declared rule is broken (for
    a key: values that occur more than once). Columns a table does not have are
    not checked."""
    found = None
    for name, declared in rules.items():
        table = tables[name]
        has = lambda columns: set(columns) <= set(table.columns)
        parts = [
            unique_violations(table, key).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(f"{', '.join(key)} unique").alias("rule"), "n_rows")
            for key in declared.keys
            if has(key)
        ]
        parts.append(
            value_violations(
                table,
                [c for c in declared.not_null if has([c])],
                {c: n for c, n in declared.max_length if has([c])},
            )
        )
        for part in parts:
            part = part.select(F.lit(name).alias("table_name"), "rule", "n_rows")
            found = part if found is None else found.unionByName(part)
    return found


def foreign_key_violations(
    tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey] = SOCIAL_FOREIGN_KEYS
) -> dict[ForeignKey, DataFrame]:
    return {k: orphans(tables[k.child], tables[k.parent], k.column, k.parent_column) for k in keys}


def dependents(table: str, keys: Sequence[ForeignKey]) -> list[str]:
    """Tables that depend on ``table``, each after all of its parents among them."""
    reached = {table}
    while new := {k.child for k in keys if k.parent in reached} - reached:
        reached |= new
    waiting, done = reached - {table}, [table]
    while waiting:
        ready = sorted(t for t in waiting if not any(k.child == t and k.parent in waiting for k in keys))
        if not ready or any(k.child == table and k.parent in reached for k in keys):
            raise ValueError(f"tables that reference each other in a circle: {sorted(waiting)}")
        done += ready
        waiting -= set(ready)
    return done[1:]


def cascade_delete(
    tables: Mapping[str, DataFrame],
    table: str,
    doomed: DataFrame,
    key: str,
    keys: Sequence[ForeignKey] = SOCIAL_FOREIGN_KEYS,
) -> dict[str, DataFrame]:
    """Delete the rows of ``table`` whose ``key`` is in ``doomed`` and all that depends on them.

    The order of ``keys`` does not matter; tables that reference each other in
    a circle are refused. Rows that were orphans before stay: only rows that
    pointed at a deleted row go.
    """
    removed: dict[str, DataFrame] = {}
    left = dict(tables)
    gone_keys = doomed.select(key)
    removed[table] = tables[table].join(gone_keys, key, "left_semi")
    left[table] = tables[table].join(gone_keys, key, "left_anti")
    for child in dependents(table, keys):
        links = [k for k in keys if k.child == child and k.parent in removed]
        gone = None
        for link in links:
            targets = removed[link.parent].select(F.col(link.parent_column).alias(link.column))
            hit = left[child].join(targets, link.column, "left_semi")
            gone = hit if gone is None else gone.unionByName(hit)
            left[child] = left[child].join(targets, link.column, "left_anti")
        if gone is not None:
            removed[child] = gone
    return left


def wrong_dimension(df: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Vectors that do not have ``dim`` entries; NULL vectors are allowed."""
    return df.where(F.col(embedding).isNotNull() & (F.size(embedding) != dim))

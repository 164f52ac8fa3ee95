import pytest
from pyspark.sql import functions as F

from sqlark.functions.numbering import number_rows
from sqlark.operators import integrity as I
from sqlark.operators.integrity import ForeignKey, cascade_delete
from sqlark.session import shared_path
from sqlark.sources.inserts import rows_to_insert, with_serial_ids
from tests.conftest import rows


def test_unique_violations(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (None, 3)], "a int, b int")
    assert rows(I.unique_violations(df, ["a", "b"])) == [(1, 1, 2)]
    assert rows(I.unique_violations(df, ["a"])) == [(1, 3)]


def test_value_violations(spark):
    df = spark.createDataFrame([("abc", None), (None, "é" * 3), ("abcd", "x")], "a string, b string")
    found = I.value_violations(df, ["a", "b"], {"a": 3, "b": 3})
    assert rows(found) == [("a length 3", 1), ("a not null", 1), ("b length 3", 0), ("b not null", 1)]


def test_golden_data_has_no_orphans(golden):
    for key, found in I.foreign_key_violations(golden).items():
        assert found.isEmpty(), key


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert rows(I.orphans(child, parent, "parent", "id").select("id", "parent")) == [(2, 9)]


def test_cascade_delete(spark, golden):
    left = I.cascade_delete(golden, "users", golden["users"].where("username = 'alice'"), "user_id")
    assert {name: df.count() for name, df in left.items()} == {
        "users": 5, "tweets": 4, "follows": 0, "likes": 4, "comments": 0,
    }
    assert rows(left["likes"].select("like_id")) == [(5,), (6,), (7,), (8,)]
    for key, found in I.foreign_key_violations(left).items():
        assert found.isEmpty(), key


def test_cascade_keeps_earlier_orphans(spark, golden):
    stray = golden["likes"].limit(1).withColumn("tweet_id", F.lit(99).cast("bigint")).withColumn("user_id", F.lit(6).cast("bigint"))
    tables = {**golden, "likes": golden["likes"].unionByName(stray)}
    left = I.cascade_delete(tables, "users", golden["users"].where("user_id = 1"), "user_id")
    assert left["likes"].where("tweet_id = 99").count() == 1


def test_wrong_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>")
    assert rows(I.wrong_dimension(df, 3).select("id")) == [(2,)]


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    numbered = number_rows(df, "n", ["k", "id"]).orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, 1001))
    assert [(r.k, r.id) for r in numbered] == sorted((i % 7, i) for i in range(1000))


def test_one_value_spreads_over_partitions_when_numbered(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    numbered = number_rows(df, "n", ["k"])
    assert numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 20_000, 20_000)
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(4, "k", "_tie")
    sizes = ranged.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 10_000


def test_serial_ids_continue_or_start_at_one(spark):
    new = spark.createDataFrame([("b",), ("a",)], "v string")
    old = spark.createDataFrame([(5,), (7,)], "id long")
    assert rows(with_serial_ids(old, new, "id", ["v"])) == [(8, "a"), (9, "b")]
    assert rows(with_serial_ids(old.limit(0), new, "id", ["v"])) == [(1, "a"), (2, "b")]


def test_insert_defaults_fill_only_missing_times(spark):
    new = spark.sql("SELECT 'a' AS v, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS at UNION ALL SELECT 'b', NULL")
    inserted = rows_to_insert(spark.createDataFrame([], "id long"), new, "id", "at", ["v"]).orderBy("id").collect()
    assert inserted[0]["at"].year == 2020 and inserted[1]["at"].year > 2020
    assert inserted[0]["id"] == 1


def test_shared_path_is_new_each_time(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x")




def test_cascade_does_not_depend_on_the_order_of_keys(spark):
    keys = [ForeignKey("c", "b_id", "b", "b_id"), ForeignKey("b", "a_id", "a", "a_id")]
    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "a_id int"),
        "b": spark.createDataFrame([(10, 1), (20, 2)], "b_id int, a_id int"),
        "c": spark.createDataFrame([(100, 10), (200, 20)], "c_id int, b_id int"),
    }
    for order in (keys, keys[::-1]):
        left = cascade_delete(tables, "a", tables["a"].where("a_id = 1"), "a_id", order)
        assert [r.c_id for r in left["c"].collect()] == [200] and left["b"].count() == 1
    with pytest.raises(ValueError, match="circle"):
        cascade_delete(tables, "a", tables["a"], "a_id", [*keys, ForeignKey("b", "c_id", "c", "c_id")])

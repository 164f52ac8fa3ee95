"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from sqlark.registered.oracles import ORACLES
from sqlark.registered.queries import QUERIES
from tests.conftest import SMALL_DATA


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SMALL_DATA)


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"e3_similarity_long", "e9_evaluation_table", "e13_experiment"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL_DATA).toPandas()
    assert compare.differences(found, duck.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "context"] and df.count() > 0

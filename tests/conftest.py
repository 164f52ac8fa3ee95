import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sqlark.session import build_session  # noqa: E402
from sqlark.sources.catalog import SOCIAL_SCHEMAS, Databases  # noqa: E402

SMALL_DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


NOW = datetime.datetime(2024, 1, 1)
NAMES = ["alice", "bob", "charlie", "cris", "dave", "eve"]
GOLDEN_ROWS = {
    "users": [(i, n, f"{n}@example.com", f"secret {i}", None, NOW) for i, n in enumerate(NAMES, 1)],
    "tweets": [(t, u, f"tweet {t}", NOW) for t, u in [(1, 1), (2, 2), (3, 1), (4, 3), (5, 4), (6, 5)]],
    "follows": [(f, 1, NOW) for f in (2, 3, 4, 5)],
    "likes": [
        (i, u, t, NOW)
        for i, (u, t) in enumerate([(2, 1), (3, 1), (4, 3), (5, 3), (2, 4), (3, 2), (4, 5), (5, 6)], 1)
    ],
    "comments": [(i, t, u, f"comment {i}", NOW) for i, (t, u) in enumerate([(1, 2), (1, 3), (2, 1), (4, 1)], 1)],
}


def golden_builders():
    return {
        name: (lambda session, name=name: session.createDataFrame(GOLDEN_ROWS[name], SOCIAL_SCHEMAS[name]))
        for name in GOLDEN_ROWS
    }


@pytest.fixture(scope="session")
def golden(spark):
    return {name: build(spark).cache() for name, build in golden_builders().items()}


@pytest.fixture(scope="session")
def databases(spark):
    return Databases(spark, {"social_network": golden_builders(), "other": {"users": golden_builders()["tweets"]}})


def rows(df):
    return sorted(tuple(r) for r in df.collect())

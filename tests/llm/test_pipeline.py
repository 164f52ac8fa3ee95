"""The stages of the pipeline on awkward and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL_DATA

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "Alpha beta, gamma delta epsilon zeta eta THETA", None, None),
    (3, None, "en", "b"),
    (4, "", "de", "b"),
    (None, "no id here at all", "de", "c"),
    (7, " ".join(f"word{i % 977}" for i in range(20_000)), "en", "c"),
    (8, "über straße 😀 \x1c <|endoftext|>", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return plain.withColumns({c: F.lit("x") for c in ("n_lines", "score", "label", "kept", "node", "ids", "__t", "bucket")})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, docs, name, stage):
    found = stage(spark, docs, SMALL_DATA)
    rows = found.collect()
    if name == "near_dedup":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "7", "8", "None"]
    else:
        assert len(rows) == len(ROWS)
    if name != "bpe":
        assert found.columns == docs.columns
    assert stage(spark, docs.limit(0), SMALL_DATA).count() == 0

import pytest
from pyspark.sql import functions as F

from sqlark.operators import transcripts as C
from tests.conftest import rows


@pytest.fixture(scope="module")
def turns(spark):
    data = [
        (1, 0, "user", "Hi"), (1, 1, "planner", "Plan"), (1, 2, "writer", "SELECT"), (1, 3, "reviewer", "Bad"),
        (1, 4, "writer", "SELECT 1 terminate"), (1, 6, "user", ""), (1, 7, "user", None),
        (2, 0, "user", "x TERMINATE"),
    ]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("speaker", F.col("role"))


def test_final_messages(turns):
    assert sorted(map(tuple, C.final_messages(turns).collect())) == [(1, 7, "user", None), (2, 0, "user", "x TERMINATE")]


def test_stop_flags(turns):
    flags = turns.select("conv_id", "turn", C.ends_with_stop("text"), C.mentions_stop("text"))
    assert {r[:2] for r in flags.collect() if r[2]} == {(1, 4), (2, 0)}
    assert {r[:2] for r in flags.collect() if r[3]} == {(1, 4), (2, 0)}


def test_stop_word_inside_is_only_mentioned(spark):
    df = spark.createDataFrame([("please terminate now",), ("Terminate",), ("",)], "t string")
    assert [tuple(r) for r in df.select(C.ends_with_stop("t"), C.mentions_stop("t")).collect()] == [(False, True), (True, True), (False, False)]


def test_shown_text(spark):
    df = spark.createDataFrame([("",), ("a TERMINATE b",), ("terminate",), (None,)], "t string")
    assert [r[0] for r in df.select(C.shown_text("t")).collect()] == ["Agents are working on the request...", "a  b", "terminate", None]


def test_next_speaker(turns):
    rule = C.next_speaker("speaker", C.mentions_stop("text"))
    found = [r[0] for r in turns.where("conv_id = 1").orderBy("turn").select(rule).collect()]
    assert found == ["planner", "writer", "reviewer", "writer", "user", "planner", "planner"]
    assert turns.select(C.next_speaker(F.lit("guest"), F.lit(False))).first()[0] == "auto"


@pytest.mark.parametrize("block", [2, 4096])
def test_transition_audit(turns, block):
    audit = {(r.speaker, r.expected, r.observed): (r.n_transitions, r.follows_rule, r.repeats) for r in C.transition_audit(turns, rows_per_block=block).collect()}
    assert audit == {
        ("user", "planner", "planner"): (1, True, False),
        ("planner", "writer", "writer"): (1, True, False),
        ("writer", "reviewer", "reviewer"): (1, True, False),
        ("reviewer", "writer", "writer"): (1, True, False),
        ("writer", "user", "user"): (1, True, False),
        ("user", "planner", "user"): (1, False, True),
    }


def test_first_rounds_prunes_before_the_shuffle(turns):
    kept = C.first_rounds(turns, 2)
    assert rows(kept.select("conv_id", "turn")) == [(1, 0), (1, 1), (2, 0)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert C.first_rounds(turns).count() == 8


def test_rendering(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "Hi", None), (1, 1, "planner", None, ("find", "{}")), (1, 2, "writer", None, None), (1, 3, "user", "Bye", None)],
        "conv_id long, turn long, role string, text string, call struct<name: string, arguments: string>",
    )
    assert C.rendered_transcripts(df, call="call").first().text == (
        "**user** (user): <span style='color:blue'>Hi</span>\n\n"
        "**planner** (planner): <span style='color:green'>Function Call - find with arguments {}</span>\n\n"
        "**user** (user): <span style='color:blue'>Bye</span>"
    )


def test_message_json(spark):
    df = spark.sql("SELECT named_struct('content', 'a\"b') AS a, CAST(NULL AS STRUCT<content: STRING>) AS b")
    assert df.select(C.message_json("a", "b")).first()[0] == '{"agents_chat":{"content":"a\\"b"},"user_chat":null}'

import random

import pytest
from pyspark.sql import functions as F

from sqlark.functions.answers import loose_sql, strict_sql
from sqlark.functions.similarity import lcs_length, register_similarity, similarity
from sqlark.operators import results as R
from sqlark.operators import scoring as C
from sqlark.plans.evaluation import score_answers
from sqlark.plans.experiment import run_experiment, sweep
from sqlark.operators.embedding import hashing_models
from sqlark.session import shared_path
from sqlark.sources.questions import read_question_set
from sqlark.sources.documents import extract_pages, form_feed_pages, read_document_files, read_page_table
from sqlark.sources.tracking import log_runs, read_csv, read_runs, write_csv
from sqlark.operators.results import RefusedQuery, contains_result, query
from tests.conftest import rows


# Similarity and extraction ----------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_equals_the_plain_table():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == lcs_length(b, a) == plain_lcs(a, b)


def test_similarity(spark):
    pairs = [("kitten", "sitting"), ("x", "x"), ("", ""), ("", "x"), (None, "x"), (None, None), ("ab", "cd"), ("a" * 20000, "b" + "a" * 19999)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(similarity("a", "b")).collect()] == [62, 100, 100, 0, 0, 0, 0, 100]


def test_similarity_in_sql(spark):
    register_similarity(spark)
    assert spark.sql("SELECT lcs_ratio('kitten', 'sitting')").first()[0] == 62


def test_sql_from_answers(spark):
    answers = [
        "Use ```sql\nSELECT 1;\n``` TERMINATE",
        "`sql SELECT 2` and `sql SELECT 3`",
        "```sql SELECT 4 Terminate\n```",
        "no code",
        None,
    ]
    df = spark.createDataFrame([(a,) for a in answers], "outputs string")
    loose, strict = zip(*df.select(loose_sql("outputs"), strict_sql("outputs")).collect())
    assert loose == ("\nSELECT 1;\n", " SELECT 2", " SELECT 4 Terminate\n", "", "")
    assert strict == ("SELECT 1;", "", "SELECT 4", "", "")


# Results ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def session(databases):
    return databases.session("social_network")


def test_only_queries_run(databases):
    run = lambda sql: R.execute(databases, "social_network", sql)
    assert run("SELECT 1;").rows.collect() == [(1,)]
    assert run("WITH t AS (SELECT 1 AS x) SELECT * FROM t -- done").rows.collect() == [(1,)]
    assert run("SELECT username FROM users ORDER BY username DESC LIMIT 1").rows.collect() == [("eve",)]
    for sql in ("", None, ";", "INSERT INTO users VALUES (1)", "DROP VIEW users", "SELECT nothing FROM users", "SET x=1",
                "SELECT 1) q; DROP VIEW users; --", "CREATE TABLE t AS SELECT 1", "SELECT * FROM parquet.`/tmp`"):
        outcome = run(sql)
        assert outcome.rows is None and outcome.error, sql
    refused = run("SELECT reflect('java.lang.System', 'getProperty', 'user.dir')")
    assert refused.rows is None and refused.error == "RefusedQuery"
    assert R.execute(databases, "social_network", "SELECT 1 FROM users").rows.count() == 6


def test_column_names(session):
    df = R.query(session, "SELECT username, count(*), 1 + 1 AS two FROM users GROUP BY username")
    assert R.column_names(df) == ["username", "Column2", "two"] and R.named(df).columns == ["username", "Column2", "two"]


SAME = [
    ("SELECT user_id FROM users", "SELECT user_id FROM users", True, True),
    ("SELECT user_id FROM users", "SELECT user_id AS other FROM users ORDER BY 1 DESC", True, True),
    ("SELECT user_id FROM users", "SELECT CAST(user_id AS DOUBLE) FROM users", True, True),
    ("SELECT user_id FROM likes", "SELECT DISTINCT user_id FROM likes", False, False),
    ("SELECT DISTINCT user_id FROM likes", "SELECT user_id FROM likes", False, True),
    ("SELECT user_id, username FROM users", "SELECT username, user_id FROM users", False, True),
    ("SELECT username FROM users", "SELECT user_id, username FROM users", False, True),
    ("SELECT username AS x FROM users WHERE user_id = 1", "SELECT email, username AS y FROM users", False, True),
    ("SELECT username FROM users", "SELECT username FROM users WHERE user_id > 2", False, False),
    ("SELECT user_id FROM users", "SELECT CAST(user_id AS STRING) FROM users", False, False),
    ("SELECT bio FROM users", "SELECT CAST(NULL AS STRING) FROM users", True, True),
    ("SELECT NULL FROM users", "SELECT CAST(NULL AS INT) FROM users", True, True),
    ("SELECT 1 WHERE false", "SELECT 1, 2 WHERE false", True, True),
    ("SELECT 1 WHERE false", "SELECT 1", False, True),
    ("SELECT 1", "SELECT 1 WHERE false", False, False),
    ("SELECT map('a', 1, 'b', 2)", "SELECT map('b', 2, 'a', 1)", True, True),
]


@pytest.mark.parametrize("expected,generated,same,contained", SAME)
def test_result_comparison(session, expected, generated, same, contained):
    a, b = R.query(session, expected), R.query(session, generated)
    assert R.same_result(a, b) is same
    assert R.contains_result(a, b) is contained


def test_ordered_comparison(session):
    up, down = (R.query(session, f"SELECT user_id FROM users ORDER BY user_id {way}") for way in ("ASC", "DESC"))
    assert R.same_result(up, down) and R.same_result(up, up, ordered=True)
    assert not R.same_result(up, down, ordered=True)


# Scores and the evaluation table ------------------------------------------------


def test_coincidence(spark):
    df = spark.createDataFrame(
        [(True, "no", False), (False, "Yes.", False), (False, "no", True), (False, None, True), (False, None, None), (None, None, None)],
        "equal boolean, verdict string, contained boolean",
    )
    score = C.coincidence(F.col("equal"), F.col("verdict"), F.col("contained"))
    assert [r[0] for r in df.select(score).collect()] == [1, 1, 0, 1, 0, 0]


def test_metrics_and_best_run(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("none",)], "run_id string")
    scored = spark.createDataFrame([("a", 50, 1), ("a", 60, 0), ("b", 40, 1), ("b", 20, 0)], "run_id string, similarity int, result_coincidence int")
    metrics = C.run_metrics(runs, scored)
    assert rows(metrics) == [("a", 55.0, 0.5), ("b", 30.0, 0.5), ("none", 0.0, 0.0)]
    assert C.best_configuration(metrics).first().run_id == "a"


def test_sweep_has_all_configurations(spark):
    assert C.configurations(spark).count() == 27 == len(sweep())
    assert {r.run_id for r in C.configurations(spark).collect()} == {c.run_id for c in sweep()}


GOLDEN = "SELECT user_id, tweet_id FROM likes"
ANSWERS = {
    "same in a fence": (f"```sql\n{GOLDEN};\n``` TERMINATE", 1),
    "other order": (f"```sql\n{GOLDEN} ORDER BY tweet_id DESC```", 1),
    "extra column": ("`sql SELECT user_id, tweet_id, like_id FROM likes`", 1),
    "columns swapped": ("`sql SELECT tweet_id, user_id FROM likes`", 1),
    "wrong filter": (f"`sql {GOLDEN} WHERE user_id > 2`", 0),
    "invalid": ("`sql SELEC`", 0),
    "fails on the way": ("`sql SELECT user_id, tweet_id, 1 / (user_id - 2) FROM likes`", 0),
    "no fence": (GOLDEN, 0),
    "not a query": ("`sql INSERT INTO likes VALUES (1, 2, 3, NULL)`", 0),
}


def test_evaluation_table(spark, databases):
    data = [("r", q, GOLDEN, outputs) for q, (outputs, _) in ANSWERS.items()]
    df = spark.createDataFrame(data, "run_id string, question string, expected_sql string, outputs string")
    found = {r.question: r for r in score_answers(spark, df, databases, "social_network").collect()}
    assert {q: r.result_coincidence for q, r in found.items()} == {q: c for q, (_, c) in ANSWERS.items()}
    assert found["no fence"].generated_sql == "" and found["no fence"].similarity == 0
    assert found["invalid"].generated_result == "Error"
    assert found["same in a fence"].expected_result == found["same in a fence"].generated_result
    assert found["same in a fence"].expected_result.startswith("8 rows ")
    ordered = score_answers(spark, df.where("question = 'other order'"), databases, "social_network", ordered=True)
    assert ordered.first().result_coincidence == 1  # contained, though not equal in order


def test_verdict_overrules_containment(spark, databases):
    df = spark.createDataFrame(
        [("r", "q", GOLDEN, "`sql SELECT user_id, tweet_id, like_id FROM likes`", "No"), ("r", "p", GOLDEN, "none", "YES")],
        "run_id string, question string, expected_sql string, outputs string, verdict string",
    )
    found = score_answers(spark, df, databases, "social_network").select("question", "result_coincidence")
    assert rows(found) == [("p", 1), ("q", 0)]


def test_failing_golden_sql_raises(spark, databases):
    df = spark.createDataFrame([("r", "q", "SELECT x", "`sql SELECT 1`")], "run_id string, question string, expected_sql string, outputs string")
    with pytest.raises(ValueError):
        score_answers(spark, df, databases, "social_network")


def test_results_of_any_size_are_kept_whole(spark, databases, tmp_path):
    sql = "SELECT a.user_id FROM likes a, likes b, likes c, likes d"
    df = spark.createDataFrame([("r", "q", sql, f"`sql {sql}`")], "run_id string, question string, expected_sql string, outputs string")
    path = str(tmp_path / "results")
    row = score_answers(spark, df, databases, "social_network", results_path=path).first()
    assert row.result_coincidence == 1 and row.generated_result.startswith("4096 rows ")
    kept = spark.read.parquet(path)
    assert kept.where(kept.sql == row.expected_sql).select("row_no").distinct().count() == 4096
    assert kept.select("sql").distinct().count() == len({row.expected_sql, row.generated_sql})


def test_answers_that_do_not_fit_the_type_are_different(spark, databases):
    golden, wide = "SELECT CAST(1.5 AS DECIMAL(10,5)) AS v", "SELECT CAST(repeat('9', 38) AS DECIMAL(38,0)) AS v"
    df = spark.createDataFrame([("r", "q", golden, f"`sql {wide}`")], "run_id string, question string, expected_sql string, outputs string")
    assert score_answers(spark, df, databases, "social_network").first().result_coincidence == 0


def test_containment_tries_every_assignment(spark):
    expected = spark.createDataFrame([(1, 5), (2, 6)], "a int, b int")
    generated = spark.createDataFrame([(5, 1), (6, 2), (1, 1), (2, 2)], "x int, y int")
    assert contains_result(expected, generated)
    assert not contains_result(expected, generated.where("x = y"))
    assert contains_result(spark.createDataFrame([(0.0,)], "a double"), spark.createDataFrame([(-0.0, 1)], "b double, c int"))


def test_calls_into_the_host_are_refused_however_wide(databases):
    session = databases.session("social_network")
    wide = ", ".join(f"{i} AS c{i}" for i in range(60))
    call = "reflect('java.lang.System', 'getProperty', 'user.dir')"
    for sql in (f"SELECT {wide}, {call} AS x", f"SELECT (SELECT `reflect`('java.lang.System', 'lineSeparator')) AS x, {wide}", f"SELECT {call.replace('reflect', 'java_method/**/')}"):
        with pytest.raises(RefusedQuery):
            query(session, sql)
    assert query(session, "SELECT 'reflect(' AS word").first()[0] == "reflect("


def test_experiment(spark, databases):
    documents = spark.createDataFrame(
        [(1, "Users write tweets. Users follow users."), (2, "Likes belong to tweets.\nComments too.")], "doc_id long, text string"
    )
    questions = spark.createDataFrame([("Who likes?", "SELECT user_id FROM likes"), ("Users?", "SELECT username FROM users")], "question string, expected_sql string")
    seen = []

    def generate(asked):
        seen.extend(asked.collect())
        right = F.concat(F.lit("`sql "), "expected_sql", F.lit("`"))
        return asked.withColumn("outputs", F.when(F.col("run_id").startswith("16/"), right).otherwise("`sql SELECT 1`"))

    configs = sweep(chunk_sizes=[16, 32, 64])
    done = run_experiment(spark, documents, questions, generate, databases, "social_network", hashing_models(64), configs)
    assert len(seen) == 54 and all(f"vector_embeddings_{r.run_id.split('/')[0]}" in r.prompt for r in seen)
    metrics = {r.run_id: (r.average_similarity, r.average_accuracy) for r in done.metrics.collect()}
    assert len(metrics) == 27
    # The inline fence keeps the space after the word, so texts differ by one character.
    assert all((m[0] >= 98 and m[1] == 1.0) is run.startswith("16/") for run, m in metrics.items())
    assert spark.read.schema(done.evaluation.schema).option("header", True).csv(done.csv).count() >= 54
    assert read_runs(spark, done.runs).where(F.col("params")["top_k"] == "3").count() == 27
    assert spark.read.schema("text string, chunk_set string").parquet(done.vectors).count() == 0
    assert C.best_configuration(done.metrics).first().run_id.startswith("16/")


# Sources and sinks ----------------------------------------------------------------


def test_csv_round_trip(spark):
    data = [("q\nwith \"quotes\", commas", "SELECT\r\n1", 5), ("  space ", "x", None), ("\\n", "'", 0)]
    df = spark.createDataFrame(data, "question string, sql string, similarity int")
    path = shared_path(spark, "csv")
    write_csv(df, path)
    assert sorted(map(tuple, read_csv(spark, path, df.schema).collect())) == sorted(data)


def test_run_log_appends(spark):
    path = shared_path(spark, "runs")
    run = spark.sql("SELECT 'a' AS run_id, map('k', '1') AS params, map('m', 0.5D) AS metrics")
    log_runs(run, path)
    log_runs(run.withColumn("run_id", F.lit("b")), path)
    assert sorted((r.run_id, r.params, r.metrics) for r in read_runs(spark, path).collect()) == [
        ("a", {"k": "1"}, {"m": 0.5}), ("b", {"k": "1"}, {"m": 0.5}),
    ]


def test_question_files(spark):
    path = shared_path(spark, "questions")
    spark.createDataFrame([('{\n "How\\nmany?": "SELECT 1;",\n "Q2": "SELECT 2"\n}',)], "value string").coalesce(1).write.text(path)
    assert rows(read_question_set(spark, path)) == [("How\nmany?", "SELECT 1;"), ("Q2", "SELECT 2")]


def test_document_files(spark):
    path = shared_path(spark, "documents")
    spark.createDataFrame([("page one\nline",), ("",), ("page é",)], "value string").coalesce(1).write.option("lineSep", "\f").text(path)
    pages = extract_pages(read_document_files(spark, path, "*.txt"), form_feed_pages)
    assert [(r.page_no, r.text) for r in pages.orderBy("page_no").collect()] == [(0, "page one\nline"), (1, ""), (2, "page é")]


def test_page_table(spark):
    path = shared_path(spark, "pages")
    spark.createDataFrame([(1, 0, "a", "x")], "conv long, turn long, body string, other string").write.parquet(path)
    df = read_page_table(spark, path, "conv", "turn", "body")
    assert rows(df) == [(1, 0, "a")] and df.columns == ["doc_id", "page_no", "text"]

"""The ten analytic questions on the hand-checked fixture, as DataFrames and as SQL."""

import pytest

from sqlark.operators import analytics as A
from sqlark.operators.results import SQL_FAILURES
from sqlark.registered.queries import golden_pairs
from tests.conftest import NOW, NAMES, rows


def names(*values):
    return sorted((v,) for v in values)


def expected():
    return [
        sorted((n, f"{n}@example.com") for n in NAMES),
        [("tweet 1", "alice"), ("tweet 2", "bob"), ("tweet 3", "alice"), ("tweet 4", "charlie"), ("tweet 5", "cris"), ("tweet 6", "dave")],
        [],
        sorted((n, 4 if n == "alice" else 0) for n in NAMES),
        [("tweet 1", 2), ("tweet 2", 1), ("tweet 3", 2), ("tweet 4", 1), ("tweet 5", 1), ("tweet 6", 1)],
        [("comment 1", "bob"), ("comment 2", "charlie")],
        names("bob", "charlie", "cris", "dave"),
        [("tweet 1", 2)],
        names("eve"),
        names(*[f"tweet {i}" for i in range(1, 7)]),
    ]


def as_frames(t):
    return [
        A.users_with_email(t["users"]),
        A.tweets_with_authors(t["tweets"], t["users"]),
        A.followed_by(t["users"], t["follows"], "alice"),
        A.followers_per_user(t["users"], t["follows"]),
        A.likes_per_tweet(t["tweets"], t["likes"]),
        A.comments_of_tweet(t["comments"], t["users"], 1),
        A.likers_of_user(t["likes"], t["tweets"], t["users"], "alice"),
        A.most_commented_tweet(t["tweets"], t["comments"]),
        A.users_without_tweets(t["users"], t["tweets"]),
        A.tweets_liked_by_followers(t["tweets"], t["likes"], t["follows"], t["users"], "alice"),
    ]


@pytest.mark.parametrize("number", range(10))
def test_dataframe_answers(golden, number):
    assert rows(as_frames(golden)[number]) == expected()[number]


def answers_to_questions():
    authors = {"alice": 2, "bob": 1, "charlie": 1, "cris": 1, "dave": 1, "eve": 0}
    return [
        sorted(authors.items()),
        [("cris",), ("dave",)],
        [("tweet 3",), ("tweet 5",), ("tweet 6",)],
        [(6,)],
        [("tweet 2",), ("tweet 4",)],
        [],
        [(2, 2)],
        [("alice",), ("eve",)],
        sorted((name, NOW if n else None) for name, n in authors.items()),
        [("bob",), ("charlie",), ("cris",), ("dave",)],
    ]


@pytest.mark.parametrize("number", range(10))
def test_sql_answers(databases, number):
    session = databases.session("social_network")
    assert rows(session.sql(golden_pairs("alice", 1)[number][1])) == answers_to_questions()[number]


def test_most_commented_tweet_without_comments(golden):
    none = golden["comments"].limit(0)
    assert rows(A.most_commented_tweet(golden["tweets"], none)) == [("tweet 1", 0)]


def test_scalar_lookup_of_several_rows_fails(golden):
    users = golden["users"].union(golden["users"])
    with pytest.raises(SQL_FAILURES):
        golden["tweets"].where(golden["tweets"].user_id == A.user_id_of(users, "alice")).collect()


def test_choices(golden):
    tweets = golden["tweets"].selectExpr("CASE WHEN tweet_id > 2 THEN content END AS content")
    assert [r[1] for r in A.choices_with_all(tweets, "content").collect()] == [
        "All", "tweet 3", "tweet 4", "tweet 5", "tweet 6",
    ]


def test_databases_keep_their_names_apart(databases):
    assert databases.names() == ["other", "social_network"]
    assert "username" in databases.session("social_network").table("users").columns
    assert "content" in databases.session("other").table("users").columns
    with pytest.raises(KeyError):
        databases.session("missing")

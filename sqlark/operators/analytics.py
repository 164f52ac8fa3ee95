"""The ten analytic questions over the social schema, plus their building blocks.

Joins are written in the form that moves the least data: anti and semi joins
instead of outer joins with a null test or joins followed by DISTINCT, and
counts taken below the join, where they combine map-side. No side is hinted as
broadcast: how many rows belong to one user is not bounded, so the choice is
left to the optimizer's size estimates and to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlark.constants import ALL_DATABASES


def scalar_lookup(df: DataFrame, value: str, condition: Column) -> Column:
    """Scalar subquery used as a value: NULL without a row, an error with several."""
    return df.where(condition).select(value).scalar()


def user_id_of(users: DataFrame, username: str) -> Column:
    return scalar_lookup(users, "user_id", F.col("username") == username)


def users_with_email(users: DataFrame) -> DataFrame:
    return users.select("username", "email")


def tweets_with_authors(tweets: DataFrame, users: DataFrame) -> DataFrame:
    return tweets.join(users, "user_id").select("content", "username")


def followed_by(users: DataFrame, follows: DataFrame, username: str) -> DataFrame:
    followed = follows.where(F.col("follower_id") == user_id_of(users, username))
    followee = users.select(F.col("user_id").alias("followee_id"), "username")
    return followed.join(followee, "followee_id").select("username")


def count_by_key(df: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(counted).alias(name))


def followers_per_user(users: DataFrame, follows: DataFrame) -> DataFrame:
    counts = count_by_key(follows, "followee_id", "follower_id", "n").withColumnRenamed("followee_id", "user_id")
    return users.join(counts, "user_id", "left").select(
        "username", F.coalesce("n", F.lit(0).cast("bigint")).alias("followers_count")
    )


def likes_per_tweet(tweets: DataFrame, likes: DataFrame) -> DataFrame:
    counts = count_by_key(likes, "tweet_id", "like_id", "n")
    return tweets.join(counts, "tweet_id", "left").select(
        "content", F.coalesce("n", F.lit(0).cast("bigint")).alias("like_count")
    )


def comments_of_tweet(comments: DataFrame, users: DataFrame, tweet_id: int) -> DataFrame:
    return comments.where(F.col("tweet_id") == tweet_id).join(users, "user_id").select("content", "username")


def likers_of_user(likes: DataFrame, tweets: DataFrame, users: DataFrame, username: str) -> DataFrame:
    own = tweets.where(F.col("user_id") == user_id_of(users, username)).select("tweet_id")
    likers = likes.join(own, "tweet_id", "left_semi").select("user_id")
    return users.join(likers, "user_id", "left_semi").select("username").distinct()


def most_commented_tweet(tweets: DataFrame, comments: DataFrame) -> DataFrame:
    """The tweet with most comments; among equals the one with the lowest id."""
    counts = count_by_key(comments, "tweet_id", "comment_id", "n")
    return (
        tweets.join(counts, "tweet_id", "left")
        .select("tweet_id", "content", F.coalesce("n", F.lit(0).cast("bigint")).alias("comments_count"))
        .orderBy(F.desc("comments_count"), "tweet_id")
        .limit(1)
        .select("content", "comments_count")
    )


def users_without_tweets(users: DataFrame, tweets: DataFrame) -> DataFrame:
    return users.join(tweets, "user_id", "left_anti").select("username")


def tweets_liked_by_followers(
    tweets: DataFrame, likes: DataFrame, follows: DataFrame, users: DataFrame, username: str
) -> DataFrame:
    followers = follows.where(F.col("followee_id") == user_id_of(users, username)).select(
        F.col("follower_id").alias("user_id")
    )
    liked = likes.join(followers, "user_id", "left_semi").select("tweet_id")
    return tweets.join(liked, "tweet_id", "left_semi").select("content").distinct()


def choices_with_all(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values with the "no filter" label in front."""
    values = df.where(F.col(column).isNotNull()).select(F.lit(1).alias("place"), F.col(column).alias("choice")).distinct()
    first = df.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(ALL_DATABASES).alias("choice"))
    return first.unionByName(values).orderBy("place", "choice")

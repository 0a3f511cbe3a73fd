"""Vote roll-ups, listings, merges and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.functions import ranking
from agorafold.operators import paging
from agorafold.sources import tables


def vote_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rollup(spark, sf_dir)


def votes_by_comment_voter(spark: SparkSession, sf_dir: str, post: int = 100, voter: int = 5, limit: int = 1000) -> DataFrame:
    """Votes in the order of post and voter, from a given pair on."""
    each = tables.votes(spark, sf_dir).groupBy("post", "voter").agg(F.sum("rshares").alias("rshares"), F.max("at").alias("at"), (F.count("*") - 1).alias("num_changes"))
    start = (F.col("post") > post) | ((F.col("post") == post) & (F.col("voter") >= voter))
    return each.where(start).orderBy("post", "voter").limit(limit)


def votes_by_voter_comment(spark: SparkSession, sf_dir: str, voter: int = 3, post: int = 0, limit: int = 1000) -> DataFrame:
    """One voter's votes in the order of posts, from a post on."""
    mine = tables.votes(spark, sf_dir).where((F.col("voter") == voter) & (F.col("post") >= post))
    each = mine.groupBy("voter", "post").agg(F.sum("rshares").alias("rshares"), F.max("at").alias("at"))
    return each.orderBy("voter", "post").limit(limit)


def active_votes(spark: SparkSession, sf_dir: str, post: int = 1, limit: int = 1000) -> DataFrame:
    """The votes of one post with their value, the heaviest first."""
    own = tables.votes(spark, sf_dir).where(F.col("post") == post)
    each = own.groupBy("voter").agg(F.sum("rshares").alias("rshares"), F.max("at").alias("at"))
    whole = own.agg(F.sum("rshares").alias("whole")).crossJoin(tables.posts(spark, sf_dir).where(F.col("id") == post).select("payout"))  # one row
    value = ranking.vote_value(F.col("payout"), F.col("whole"), F.col("rshares"))
    return each.crossJoin(F.broadcast(whole)).select("voter", "rshares", "at", F.round(value, 3).alias("value")).orderBy(F.col("rshares").desc(), "voter").limit(limit)


def vote_last_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per voter and post the last plain and the last effective vote, from one pass over the votes."""
    order = F.struct("at", "rshares")
    best = lambda when: F.max(F.when(when, order))
    both = tables.votes(spark, sf_dir).groupBy("voter", "post").agg(best(~F.col("effective")).alias("plain"), best(F.col("effective")).alias("effective"), (F.count("*") - 1).alias("num_changes"))
    return both.select(
        "voter", "post", "num_changes", F.col("plain.at").alias("plain_at"), F.col("effective.at").alias("effective_at"),
        F.coalesce("effective.rshares", "plain.rshares").alias("rshares"), F.col("effective").isNotNull().alias("is_effective"),
    )


def last_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post the last weight of each kind of vote; null where a kind is absent."""
    of = lambda when: F.max(F.when(when, F.struct("at", "rshares")))["rshares"]
    return tables.votes(spark, sf_dir).groupBy("post").agg(
        of(F.col("effective")).alias("last_effective"), of(F.col("rshares") < 0).alias("last_negative"), F.bool_or("effective").alias("any_effective"), F.max("at").alias("last_at")
    )


def vote_value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and notification score of each vote on a live post."""
    sums = tables.rollup(spark, sf_dir).select("post", F.col("rshares").alias("post_rshares"), "abs_rshares")
    posts = tables.live_posts(spark, sf_dir).select("id", "payout")
    each = tables.votes(spark, sf_dir).groupBy("post", "voter").agg(F.sum("rshares").alias("rshares"))
    joined = each.join(sums, "post").join(posts, F.col("post") == F.col("id"))
    value = ranking.vote_value(F.col("payout"), F.col("post_rshares"), F.col("rshares"))
    return joined.select("post", "voter", F.round(value, 3).alias("value"), ranking.vote_score(F.col("payout"), F.col("abs_rshares"), F.col("rshares")).alias("score"))


def first_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type with the number of earlier ones."""
    events = tables.read(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(
        F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"), F.min_by("value", "event_id").alias("first_value"), (F.count("*") - 1).alias("num_changes")
    )


def latest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vote of each voter, ties by post and weight."""
    order = [F.col("at").desc(), F.col("post").desc(), F.col("rshares").desc()]
    return paging.last_per_key(tables.votes(spark, sf_dir).select("voter", "post", "rshares", "at"), ["voter"], order)

"""Single posts, lists of posts by name, and what the head of the model is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.operators import ranked
from agorafold.sources import tables

#: Pairs of a caller's list that are broadcast.
MOST_PAIRS = 100_000
MOST_REPLIES = 5000


def post(spark: SparkSession, sf_dir: str, post: int = 1, observer: int | None = None) -> DataFrame:
    """One live post with all that describes it; none if the observer mutes its author."""
    one = tables.scored_posts(spark, sf_dir).where(F.col("id") == post)
    if observer is not None:
        one = one.join(ranked.graph.muted_by(spark, sf_dir, observer), F.col("author") == F.col("muted"), "left_anti")
    return ranked.described(spark, sf_dir, one.select("id", F.round(F.col("sc_trend").cast("double"), 3).alias("score")))


def post_header(spark: SparkSession, sf_dir: str, post: int = 1) -> DataFrame:
    """Author, category and place of one live post."""
    return tables.live_posts(spark, sf_dir).where(F.col("id") == post).select("id", "author", "category", F.col("parent").isNull().alias("is_root"))


def content_replies(spark: SparkSession, sf_dir: str, post: int = 1, limit: int = MOST_REPLIES) -> DataFrame:
    """Direct replies to one post, the oldest first."""
    return tables.live_posts(spark, sf_dir).where(F.col("parent") == post).orderBy("id").limit(limit).select("id", "author", "created", "payout")


def reblogged_by(spark: SparkSession, sf_dir: str, post: int = 1) -> DataFrame:
    """Who shared one post, without its author."""
    live = tables.live_posts(spark, sf_dir).select("id", "author")
    shared = tables.reblogs(spark, sf_dir).where(F.col("post") == post)
    return shared.join(live, F.col("post") == F.col("id")).where(F.col("account") != F.col("author")).select("account", "at")


def find_comments(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Live posts of a list of (author, id) pairs, each once; pairs that name none are left out."""
    named = [(a, i) for i in range(1, 101) for a in range(1, 101)] * 2 if pairs is None else pairs
    wanted = spark.createDataFrame([tuple(map(int, p)) for p in named], "author long, id long").distinct()
    wanted = F.broadcast(wanted) if len(named) <= MOST_PAIRS else wanted
    return tables.live_posts(spark, sf_dir).join(wanted, ["author", "id"], "left_semi").select("id", "author", "payout")


def posts_of_categories(spark: SparkSession, sf_dir: str, categories: tuple[str, ...] = ("1-URGENT", "5-LOW")) -> DataFrame:
    """Live root posts per category of a list."""
    return tables.roots(tables.live_posts(spark, sf_dir)).where(F.col("category").isin(*categories)).groupBy("category").agg(F.count("*").alias("n"))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head: the newest post's time, its id and how many posts there are."""
    return tables.posts(spark, sf_dir).agg(F.max("created").alias("head"), F.max("id").alias("last_id"), F.count("*").alias("posts"))


def changed_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose category or community differs from their parent's, where either may be unknown (null-safe)."""
    posts = tables.posts(spark, sf_dir)
    above = posts.select(F.col("id").alias("p"), F.col("category").alias("pc"), F.when(F.col("community") % 5 == 0, None).otherwise(F.col("community")).alias("pm"))
    joined = posts.join(above, F.col("parent") == F.col("p"))
    unlike = ~F.col("community").eqNullSafe(F.col("pm")) | ~F.col("category").eqNullSafe(F.col("pc"))
    return joined.where(unlike).groupBy("category").agg(F.count("*").alias("n"))


def quiet_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers all of whose followed accounts have an open post: there is none followed without one."""
    follows = tables.follows(spark, sf_dir)
    active = tables.live_posts(spark, sf_dir).where(~F.col("paid")).select(F.col("author").alias("a")).distinct()
    idle = follows.join(active, F.col("following") == F.col("a"), "left_anti").select(F.col("follower").alias("f"))
    return follows.select("follower").distinct().join(idle, F.col("follower") == F.col("f"), "left_anti")


def payouts_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per community open payouts beside those of accounts that it names: of its own people, or of anyone for every seventh.

    The sevenths take the sum of all and the others join by key, so neither is
    a join of every pair.
    """
    nations = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    open_posts = tables.live_posts(spark, sf_dir).where(~F.col("paid"))
    sums = open_posts.groupBy("community").agg(F.sum("payout").alias("payout"))
    one = nations.where("nation % 7 <> 0").join(sums, F.col("community") == F.col("nation"), "left").select("nation", "payout", F.when(F.col("community").isNotNull(), 1).otherwise(0).alias("communities"))
    whole = sums.agg(F.sum("payout").alias("payout"), F.count("community").alias("communities"))  # one row
    everyone = nations.where("nation % 7 = 0").crossJoin(F.broadcast(whole)).select("nation", "payout", "communities")
    return one.unionByName(everyone).select("nation", F.col("payout").cast("decimal(30,3)").alias("payout"), F.col("communities").cast("long").alias("communities"))

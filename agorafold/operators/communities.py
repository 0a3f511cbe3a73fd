"""Payout statistics, community ranks, tags and subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.operators import paging
from agorafold.functions import stem
from agorafold.sources import tables

# Topics listed when communities leave room.
FALLBACK_TOPICS = ("photography", "travel", "life", "gaming", "crypto", "newsteem", "music", "food")


def payout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open payouts per (community, author), and per community with its number of authors (author null)."""
    live = tables.live_posts(spark, sf_dir).where(~F.col("paid"))
    sums = [F.sum("payout").alias("payout"), F.count("*").alias("posts")]
    each = live.groupBy("community", "author").agg(*sums)
    whole = each.groupBy("community").agg(F.sum("payout").cast("decimal(20,3)").alias("payout"), F.sum("posts").alias("posts"), F.count("*").alias("authors"))
    return each.withColumn("authors", F.lit(None).cast("long")).unionByName(whole.withColumn("author", F.lit(None).cast("long")).select("community", "author", "payout", "posts", "authors"))


def payout_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = tables.live_posts(spark, sf_dir).where(~F.col("paid"))
    return live.agg(F.sum("payout").alias("total"), F.sum(F.when(F.col("parent").isNull(), F.col("payout"))).alias("blogs"), F.count("*").alias("posts"))


def community_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by rounded open payouts, authors, posts, subscribers, title and id."""
    live = tables.live_posts(spark, sf_dir).where(~F.col("paid") & F.col("community").isNotNull())
    sums = live.groupBy("community").agg(F.round(F.sum("payout"), 0).cast("long").alias("payouts"), F.count("*").alias("posts"), F.countDistinct("author").alias("authors"))
    people = tables.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("community")).agg(F.count("*").alias("subscribers"))
    nations = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community"), F.col("n_name").alias("title"))
    rows = nations.join(sums, "community", "left").join(people, "community", "left").fillna(0, ["payouts", "posts", "authors", "subscribers"])
    order = [F.col("payouts").desc(), F.col("authors").desc(), F.col("posts").desc(), F.col("subscribers").desc(), F.when(F.col("title") == "", 1).otherwise(0), F.col("community").desc()]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # one row a community


def communities_keyset(spark: SparkSession, sf_dir: str, last_rank: int = 5, limit: int = 10, query: str | None = None) -> DataFrame:
    """Communities after a rank, each with its administrators: its three richest suppliers' names in order."""
    suppliers = tables.read(spark, sf_dir, "supplier")
    at = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    admins = suppliers.withColumn("at", at).where("at <= 3").groupBy(F.col("s_nationkey").alias("community")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("admins"))
    ranks = community_rank(spark, sf_dir).where(F.col("rank") > last_rank)
    if query is not None:  # all its words, in any English form, are in the title or its region's name
        regions = tables.read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("about"))
        about = tables.read(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("__n"), "about")
        named = stem.with_lexemes(ranks.join(about, F.col("community") == F.col("__n"), "left").drop("__n"), F.concat_ws(" ", "title", "about"), "__lexemes")
        ranks = named.where(stem.has_all("__lexemes", query)).drop("__lexemes", "about")
    ranks = ranks.orderBy("rank").limit(limit)
    return ranks.join(admins, "community", "left").select("community", "title", "rank", "admins")


def pop_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by posts of the last month before the head."""
    live = tables.live_posts(spark, sf_dir)
    head = F.broadcast(live.agg(F.max("created").alias("head")))
    recent = live.crossJoin(head).where(F.col("created") > F.col("head") - F.expr("interval 1 month"))
    nations = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community"), F.col("n_name").alias("title"))
    counts = recent.groupBy("community").agg(F.count("*").alias("newcomers"))
    return counts.join(nations, "community").orderBy(F.col("newcomers").desc(), F.col("community").desc()).limit(25).select("community", "title", "newcomers")


def trending_tags(spark: SparkSession, sf_dir: str, start: str | None = None, limit: int = 250) -> DataFrame:
    """Per tag all posts, root posts and open payouts, after a bound on payouts."""
    live = tables.live_posts(spark, sf_dir).where(~F.col("paid"))
    joined = tables.tags(spark, sf_dir).join(live, F.col("post") == F.col("id"))
    sums = joined.groupBy("tag").agg(F.count("*").alias("comments"), F.count_if(F.col("parent").isNull()).alias("top_posts"), F.sum("payout").alias("total_payouts"))
    some = sums.where(F.col("total_payouts") > 0)
    return paging.page(some, "total_payouts", start, limit, tie="tag")


def trending_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten communities and, below them, fixed topics, as one list."""
    best = community_rank(spark, sf_dir).orderBy("rank").limit(10).select(F.col("title").alias("name"), F.col("rank").cast("int").alias("place"))
    fixed = spark.createDataFrame([(t, 1000 + i) for i, t in enumerate(FALLBACK_TOPICS)], "name string, place int")
    return best.unionByName(fixed).orderBy("place").limit(15)


def _subscribers(spark: SparkSession, sf_dir: str, community: int | None) -> DataFrame:
    """(community, account, name, role) of one community or all."""
    people = tables.read(spark, sf_dir, "customer")
    people = people if community is None else people.where(F.col("c_nationkey") == community)
    staff = tables.read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("lead"))
    joined = people.join(staff, people.c_nationkey == staff.s_nationkey, "left")
    role = F.when(F.col("c_acctbal") < 0, "muted").when(F.col("c_custkey") % 97 == F.col("lead") % 97, "mod").otherwise("guest")
    return joined.select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("account"), F.col("c_name").alias("name"), role.alias("role"))


def subscribers_roles(spark: SparkSession, sf_dir: str, community: int = 7, start: str = "Customer#000000100", limit: int = 100) -> DataFrame:
    """Subscribers of a community with their role, in the order of names, after a name."""
    return _subscribers(spark, sf_dir, community).where(F.col("name") > start).orderBy("name").limit(limit).select("name", "role")


def community_roles(spark: SparkSession, sf_dir: str, community: int = 7, start: str = "", limit: int = 100) -> DataFrame:
    """Those of a community who have a role other than guest."""
    return _subscribers(spark, sf_dir, community).where((F.col("role") != "guest") & (F.col("name") > start)).orderBy("name").limit(limit).select("name", "role")


def all_subscriptions(spark: SparkSession, sf_dir: str, account: int = 7) -> DataFrame:
    """Communities of one account with its role there."""
    nations = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community"), F.col("n_name").alias("title"))
    return _subscribers(spark, sf_dir, None).where(F.col("account") == account).join(nations, "community").select("community", "title", "role")


def community(spark: SparkSession, sf_dir: str, community: int = 7) -> DataFrame:
    """One community with its rank and sums."""
    return community_rank(spark, sf_dir).where(F.col("community") == community)


def community_context(spark: SparkSession, sf_dir: str, community: int = 7, account: int = 7) -> DataFrame:
    """What one account is in a community: role and whether it subscribes; a guest where it doesn't."""
    own = _subscribers(spark, sf_dir, community).where(F.col("account") == account).select("role")
    found = own.agg(F.max("role").alias("role"))
    return found.select(F.coalesce("role", F.lit("guest")).alias("role"), F.col("role").isNotNull().alias("subscribed"))

"""Posts of one account and what is told of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.functions import profiles, reputation
from agorafold.operators import paging
from agorafold.sources import tables

ACCOUNT, FOLLOWER, WRITER = 7, 3, 48
FEED_DAYS = 30


def account_posts(spark: SparkSession, sf_dir: str, account: int = WRITER, last: int | None = None, limit: int = paging.LIMIT) -> DataFrame:
    """Root posts of an account."""
    rows = tables.roots(tables.live_posts(spark, sf_dir)).where(F.col("author") == account)
    return paging.page(rows, "id", last, limit).select("id", "created", "category", "payout")


def account_blog(spark: SparkSession, sf_dir: str, account: int = ACCOUNT, last: int | None = None, limit: int = paging.LIMIT, bridge: bool = False) -> DataFrame:
    """Root posts of an account and posts that it shared, the newest first.

    For the bridge without posts of communities that the account has not shared
    itself; every fifth place is none.
    """
    live = tables.live_posts(spark, sf_dir)
    own = tables.roots(live).where(F.col("author") == account).select("id", "created")
    shared = tables.reblogs(spark, sf_dir).where(F.col("account") == account).select(F.col("post").alias("id"), F.col("at").alias("created"))
    entries = own.withColumn("by_sharing", F.lit(False)).unionByName(shared.withColumn("by_sharing", F.lit(True)))
    entries = entries.groupBy("id").agg(F.min("created").alias("entered"), F.bool_or("by_sharing").alias("is_shared")).join(live.select("id", "author", "community"), "id")
    entries = entries.where(F.col("is_shared") | (F.col("community") % 5 == 0) | F.col("community").isNull()) if bridge else entries
    return paging.page(entries, "entered", last, limit).select("id", "author", "entered")


def account_blog_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_blog(spark, sf_dir, bridge=True)


def account_comments(spark: SparkSession, sf_dir: str, account: int = ACCOUNT, last: int | None = None, limit: int = paging.LIMIT) -> DataFrame:
    """Replies that an account wrote."""
    rows = tables.replies(tables.live_posts(spark, sf_dir)).where(F.col("author") == account)
    return paging.page(rows, "id", last, limit).select("id", "parent", "created")


def account_posts_by_tag(spark: SparkSession, sf_dir: str, account: int = ACCOUNT, tag: str = "Brand#21", last: int | None = None, limit: int = paging.LIMIT) -> DataFrame:
    """Posts of an account with a tag."""
    rows = tables.live_posts(spark, sf_dir).where(F.col("author") == account)
    tagged = tables.tags(spark, sf_dir).where(F.col("tag") == tag)
    return paging.page(rows.join(tagged, F.col("id") == F.col("post"), "left_semi"), "id", last, limit).select("id", "created", "category")


def account_posts_before(spark: SparkSession, sf_dir: str, account: int = 6, before: str = "2000-01-01", limit: int = 10) -> DataFrame:
    """Root posts of an account from before a date."""
    rows = tables.roots(tables.live_posts(spark, sf_dir)).where((F.col("author") == account) & (F.col("created") < F.lit(before).cast("timestamp_ntz")))
    return paging.top(rows, "created", limit).select("id", "created", "payout")


def account_replies(spark: SparkSession, sf_dir: str, account: int = ACCOUNT, last: int | None = None, limit: int = paging.LIMIT) -> DataFrame:
    """Replies by anyone to posts of one account."""
    live = tables.live_posts(spark, sf_dir)
    own = live.where(F.col("author") == account).select(F.col("id").alias("parent"))
    return paging.page(live.join(own, "parent"), "id", last, limit).select("id", "author", "parent", "created")


def account_payout(spark: SparkSession, sf_dir: str, account: int = ACCOUNT, last: int | None = None, limit: int = paging.LIMIT) -> DataFrame:
    rows = tables.live_posts(spark, sf_dir).where((F.col("author") == account) & ~F.col("paid"))
    return paging.page(rows, "payout", last, limit).select("id", "payout", "category")


def _feed(spark: SparkSession, sf_dir: str, account: int, days: int | None = None) -> DataFrame:
    """Posts that followed accounts wrote or shared (in the last days, if given), each once, with those accounts' names."""
    followed = tables.follows(spark, sf_dir).where(F.col("follower") == account).select("following")
    live = tables.live_posts(spark, sf_dir)
    names = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    own = live.select("id", F.col("author").alias("by"), F.col("created").alias("at"))
    shared = live.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.col("author").alias("by"), F.col("created").alias("at"))
    entries = own.unionByName(shared).join(followed, F.col("by") == F.col("following"), "left_semi")
    if days is not None:
        head = live.agg((F.max("created") - F.expr(f"interval {days} days")).alias("cut"))  # one row
        entries = entries.crossJoin(F.broadcast(head)).where(F.col("at") > F.col("cut"))
    named = entries.join(names, entries.by == names.c_custkey)
    return named.groupBy("id").agg(F.min("at").alias("first_at"), F.array_join(F.array_sort(F.collect_set("c_name")), ",").alias("names"))


def account_feed(spark: SparkSession, sf_dir: str, account: int = FOLLOWER, limit: int = 50, last: int | None = None) -> DataFrame:
    """The newest of all posts that followed accounts wrote or shared; after one of them."""
    return paging.page(_feed(spark, sf_dir, account), "first_at", last, limit).select("id", "first_at", "names")


def account_feed_month(spark: SparkSession, sf_dir: str, account: int = FOLLOWER, limit: int = 50, last: int | None = None) -> DataFrame:
    """The feed that callers of methods see, which ends after a month."""
    return paging.page(_feed(spark, sf_dir, account, FEED_DAYS), "first_at", last, limit).select("id", "first_at", "names")


def account_feed_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of a month's feed after its first five."""
    first = account_feed_month(spark, sf_dir, limit=5).orderBy("first_at", "id").limit(1).select("first_at", "id")
    feed = account_feed_month(spark, sf_dir, limit=1_000_000)
    return paging.top(paging.after(feed, "first_at", first), "first_at", 5).select("id", "first_at", "names")


def blog_entries(spark: SparkSession, sf_dir: str, account: int = ACCOUNT, start: int | None = None, limit: int = 10) -> DataFrame:
    """An account's posts numbered from 0; a page that ends at entry ``start``, by default the last one."""
    rows = tables.live_posts(spark, sf_dir).where(F.col("author") == account)
    numbered = rows.withColumn("entry", F.row_number().over(Window.partitionBy("author").orderBy("created", "id")) - 1)
    last = Window.partitionBy("author")
    end = F.max("entry").over(last) if start is None else F.lit(start)
    return numbered.withColumn("last", end).where((F.col("entry") > F.col("last") - limit) & (F.col("entry") <= F.col("last"))).select("author", "entry", "id", "created")


def account_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account with its count of posts and the latest of last post, last reply to it and last vote on it."""
    live = tables.live_posts(spark, sf_dir)
    own = live.groupBy("author").agg(F.count("*").alias("post_count"), F.max("created").alias("last_post"))
    voted = tables.votes(spark, sf_dir).groupBy("post").agg(F.max("at").alias("at"))
    on_own = voted.join(live.select("id", "author"), F.col("post") == F.col("id")).groupBy("author").agg(F.max("at").alias("last_vote"))
    accounts = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("name"))
    joined = accounts.join(own, accounts.account == own.author, "left").drop("author").join(on_own, F.col("account") == on_own.author, "left")
    return joined.select("account", "name", F.coalesce("post_count", F.lit(0)).alias("post_count"), F.greatest("last_post", "last_vote").alias("active_at"))


def reputation_display(spark: SparkSession, sf_dir: str, start: int | None = None, limit: int | None = None) -> DataFrame:
    """Raw and shown reputations of all accounts, or of ``limit`` from one on."""
    raw = F.round(F.col("c_acctbal") * 100).cast("long") * 10_000_000_000
    rows = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), raw.alias("raw"))
    rows = rows if start is None else rows.where(F.col("account") >= start)
    rows = rows if limit is None else rows.orderBy("account").limit(limit)
    return rows.select("account", "raw", reputation.display(F.col("raw")).cast("double").alias("reputation"), reputation.notification_score(F.col("raw")).alias("score"))


def profile_fields(spark: SparkSession, sf_dir: str, accounts: list[int] | None = None) -> DataFrame:
    """Profiles from metadata documents made of the accounts' names and segments; of all accounts or of a list."""
    chosen, accounts = accounts, tables.read(spark, sf_dir, "customer")
    accounts = accounts if chosen is None else accounts.where(F.col("c_custkey").isin(*chosen))
    document = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name")).alias("about"), F.concat(F.col("c_mktsegment"), F.lit(".example.org")).alias("website")).alias("profile")))
    made = accounts.select(F.col("c_custkey").alias("account"), document.alias("posting"))
    found = made.select("account", profiles.profile(F.col("posting"), F.lit("")).alias("p"))
    return found.select("account", F.col("p.name").alias("name"), F.col("p.about").alias("about"), F.col("p.website").alias("website"))

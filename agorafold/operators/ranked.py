"""Ranked listings: six orders over all posts, a tag, a community or an observer's communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.operators import graph, paging
from agorafold.sources import tables

TAG, CATEGORY, COMMUNITY, OBSERVER = "Brand#13", "1-URGENT", 7, 1
PAYOUT_DAYS = 7


def _scores(rows: DataFrame, score: str, places: int = 3) -> DataFrame:
    return rows.select("id", "author", "category", F.round(F.col(score).cast("double"), places).alias("score"))


def candidates(spark: SparkSession, sf_dir: str, sort: str, bridge: bool = True, in_communities: bool = False) -> DataFrame:
    """Rows and order column of one sort: live posts under its own conditions.

    trending, hot and created list root posts; payout lists what is due within
    a day, of any depth, or, for callers other than the bridge, root posts at
    any time; payout_comments lists replies, muted grayed authors' posts.  In
    communities (one, or the observer's) payout, payout_comments and muted list
    root posts, as the reference has it.
    """
    if sort in ("trending", "hot"):
        rows = tables.roots(tables.scored_posts(spark, sf_dir)).where(~F.col("paid"))
        return rows.withColumn("rank_by", F.col("sc_trend" if sort == "trending" else "sc_hot"))
    live = tables.live_posts(spark, sf_dir)
    if sort == "created":
        return tables.roots(live).withColumn("rank_by", F.col("id"))
    open_posts = live.where(~F.col("paid")).withColumn("rank_by", F.col("payout"))
    open_posts = tables.roots(open_posts) if in_communities else open_posts
    if sort == "payout" and not bridge and not in_communities:
        return tables.roots(open_posts)
    if sort == "payout":
        head = live.agg(F.max("created").alias("head"))
        at = F.col("created") + F.expr(f"interval {PAYOUT_DAYS} days")
        due = at.between(F.col("head") + F.expr("interval 12 hours"), F.col("head") + F.expr("interval 36 hours"))
        return open_posts.crossJoin(F.broadcast(head)).where(due).drop("head")  # one row
    if sort == "payout_comments":
        return open_posts if in_communities else tables.replies(open_posts)
    if sort == "muted":
        return open_posts.where(F.col("grayed") & (F.col("payout") > 0))
    raise ValueError(f"no such order: {sort}")


def ranked(spark: SparkSession, sf_dir: str, sort: str, tag: str | None = None, community: int | None = None, observer: int | None = None, last: int | None = None, limit: int = paging.LIMIT, mutes_of: int | None = None, without: int = 0, bridge: bool = True) -> DataFrame:
    """One page of a sort within a scope; posts by authors whom ``mutes_of`` mutes, or with a reason in the mask ``without``, are left out.

    A tag is a category for payout and payout_comments.  Grayed authors are
    left out of created but in one community; muted lists them, and knows no
    observer's mutes.
    """
    rows = candidates(spark, sf_dir, sort, bridge, community is not None or observer is not None)
    if sort == "created" and community is None:
        rows = rows.where(~F.col("grayed"))
    if without:
        rows = rows.where(reasons().bitwiseAND(F.lit(without)) == 0)
    if tag is not None and sort in ("payout", "payout_comments"):
        rows = rows.where(F.col("category") == tag)
    elif tag is not None:
        tagged = tables.tags(spark, sf_dir).where(F.col("tag") == tag).select("post")
        rows = rows.join(tagged, F.col("id") == F.col("post"), "left_semi")
    if community is not None:
        rows = rows.where(F.col("community") == community)
    if observer is not None:
        rows = rows.join(graph.subscriptions(spark, sf_dir, observer), "community", "left_semi")
    if mutes_of is not None and sort != "muted":
        rows = rows.join(graph.muted_by(spark, sf_dir, mutes_of), F.col("author") == F.col("muted"), "left_anti")
    return paging.page(rows, "rank_by", last, limit)


def reasons() -> Column:
    """The mask of a post's own reasons for muting: its community's kind (bit 1), its author's reputation (bit 3)."""
    return F.when(F.col("community") % 7 == 0, 1 << 1).otherwise(0).bitwiseOR(F.when(F.col("grayed"), 1 << 3).otherwise(0))


SORTS = ("trending", "hot", "created", "payout", "payout_comments", "muted")
SCOPES = {"all": {}, "tag": {"tag": TAG}, "community": {"community": COMMUNITY}, "my": {"observer": OBSERVER}}
#: Pairs that have a query by another name below.
NAMED = {("trending", "all"), ("hot", "all"), ("created", "all"), ("payout", "all"), ("payout_comments", "all"), ("muted", "all"), ("trending", "tag"), ("trending", "community"), ("hot", "my")}


def pairs() -> dict:
    """A query for every other pair of order and scope."""

    def query(sort: str, scope: str):
        given = {"tag": CATEGORY} if scope == "tag" and sort in ("payout", "payout_comments") else SCOPES[scope]
        return lambda spark, sf_dir: _scores(ranked(spark, sf_dir, sort, **given), "rank_by")

    return {f"ranked_{sort}_{scope}": query(sort, scope) for sort in SORTS for scope in SCOPES if (sort, scope) not in NAMED}


def ranked_without_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trending posts without those that a community's kind or a reputation mutes."""
    return _scores(ranked(spark, sf_dir, "trending", without=(1 << 1) | (1 << 3)), "rank_by")


def ranked_payout_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payouts as callers other than the bridge see them: root posts at any time."""
    return _scores(ranked(spark, sf_dir, "payout", bridge=False), "rank_by")


def ranked_trending_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "trending"), "rank_by")


def ranked_hot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "hot"), "rank_by")


def ranked_created_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "created"), "rank_by")


def ranked_payout_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "payout"), "rank_by")


def ranked_payout_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "payout_comments"), "rank_by")


def ranked_muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "muted"), "rank_by")


def ranked_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "trending", tag=TAG), "rank_by")


def ranked_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "trending", community=COMMUNITY), "rank_by")


def ranked_my_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(ranked(spark, sf_dir, "hot", observer=OBSERVER), "rank_by")


def ranked_my_lateral_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5 of each community that the observer subscribes to, then the newest of these."""
    rows = candidates(spark, sf_dir, "created").where(~F.col("grayed")).join(graph.subscriptions(spark, sf_dir, OBSERVER), "community", "left_semi")
    each = paging.top_per_group(rows, "community", F.col("id").desc(), 5)
    return paging.top(each, "rank_by").select("id", "author", "category", "community")


def ranked_pinned_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned posts of a community before its trending ones."""
    rows = candidates(spark, sf_dir, "trending").where(F.col("community") == COMMUNITY)
    pinned = (F.col("category") == "1-URGENT") & (F.col("payout") > 400000)
    found = paging.two_tier(rows, pinned, "rank_by")
    return found.select("id", "tier", F.when(F.col("tier") == 1, F.round(F.col("rank_by").cast("double"), 3)).alias("score"))


def keyset_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows the first trending page, by its last row."""
    rows = candidates(spark, sf_dir, "trending")
    bound = paging.top(rows, "rank_by").orderBy(F.col("rank_by").asc(), F.col("id").asc()).limit(1)
    return _scores(paging.top(paging.after(rows, "rank_by", bound), "rank_by"), "rank_by")


def observer_mute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trending posts without authors whom the observer or a followed list mutes."""
    return _scores(ranked(spark, sf_dir, "trending", mutes_of=OBSERVER), "rank_by")


def described(spark: SparkSession, sf_dir: str, page: DataFrame) -> DataFrame:
    """Whole posts of a page (id, score), in its order: the page is found first, then joined to what describes it."""
    posts = tables.posts(spark, sf_dir)
    people = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = tables.read(spark, sf_dir, "nation")
    regions = tables.read(spark, sf_dir, "region")
    chosen = page.select("id", "score").join(posts.select("id", "author", "created", "payout", "category", "parent"), "id")
    above = posts.select(F.col("id").alias("parent"), F.col("author").alias("parent_author_id"))
    names = people.select(F.col("c_custkey").alias("parent_author_id"), F.col("c_name").alias("parent_author"))
    return (
        chosen.join(people, chosen.author == people.c_custkey, "left")
        .join(nations, F.col("c_nationkey") == nations.n_nationkey, "left")
        .join(regions, F.col("n_regionkey") == regions.r_regionkey, "left")
        .join(above, "parent", "left")
        .join(names, "parent_author_id", "left")
        .select("id", F.col("c_name").alias("author_name"), F.col("n_name").alias("community_title"), F.col("r_name").alias("region_name"), "category", "payout", "score", "parent", "parent_author")
        .orderBy(F.col("score").desc_nulls_last(), F.col("id").desc())
    )


def star_join_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole posts of the first trending page."""
    return described(spark, sf_dir, _scores(ranked(spark, sf_dir, "trending"), "rank_by"))

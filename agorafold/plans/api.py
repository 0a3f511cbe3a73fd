"""Methods by name with their parameters checked, as DataFrames; no network.

``call("bridge.get_ranked_posts", spark, sf_dir, {"sort": "hot", "limit": 5})``

A method takes what its operator takes; ``limit`` has a range of its own, and
required parameters have no default here.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.functions import bitmask
from agorafold.operators import accounts, communities, graph, lookups, notices, ranked, search, threads, voting

MOST_ROWS = 100


class BadParameter(ValueError):
    """A method or parameter that isn't known or is out of range."""


def _one_of(name: str, value: str, known) -> None:
    if value not in known:
        raise BadParameter(f"{name} must be one of {', '.join(known)}")


def get_ranked_posts(spark: SparkSession, sf_dir: str, sort: str, tag: str | None = None, community: int | None = None, observer: int | None = None, my: bool = False, last: int | None = None, limit: int = 20, without: list[int] | None = None) -> DataFrame:
    """my: of the observer's communities; without: numbers of reasons for muting."""
    _one_of("sort", sort, ranked.SORTS)
    if my and observer is None:
        raise BadParameter("my needs an observer")
    if any(r not in range(5) for r in without or []):
        raise BadParameter("without has numbers from 0 to 4")
    return ranked.ranked(spark, sf_dir, sort, tag=tag, community=community, observer=observer if my else None, last=last, limit=limit, mutes_of=observer, without=sum(1 << r for r in set(without or [])))


def get_account_posts(spark: SparkSession, sf_dir: str, sort: str, account: int, last: int | None = None, limit: int = 20) -> DataFrame:
    kinds = {"blog": accounts.account_blog, "posts": accounts.account_posts, "comments": accounts.account_comments, "replies": accounts.account_replies, "payout": accounts.account_payout}
    if sort == "feed":
        return accounts.account_feed_month(spark, sf_dir, account, limit, last)
    if sort == "blog":
        return accounts.account_blog(spark, sf_dir, account, last, limit, bridge=True)
    _one_of("sort", sort, [*kinds, "feed"])
    return kinds[sort](spark, sf_dir, account, last, limit)


def discussions(sort: str) -> Callable[..., DataFrame]:
    """Listings for callers other than the bridge."""

    def get(spark: SparkSession, sf_dir: str, tag: str | None = None, last: int | None = None, limit: int = 20) -> DataFrame:
        return ranked.ranked(spark, sf_dir, sort, tag=tag, last=last, limit=limit, bridge=False)

    return get


def get_follow_list(spark: SparkSession, sf_dir: str, account: int, kind: str = "muted") -> DataFrame:
    _one_of("kind", kind, ("muted", "follow_muted"))
    return graph.follow_list(spark, sf_dir, account, kind)


def find_text(spark: SparkSession, sf_dir: str, query: str, author: str | None = None, sort: str = "relevance", last: int | None = None, limit: int = 20) -> DataFrame:
    _one_of("sort", sort, ("relevance", "created"))
    if not search.parse(query):
        raise BadParameter("query has no word")
    return search.find_text(spark, sf_dir, query, author, sort, last, limit)


def list_votes(spark: SparkSession, sf_dir: str, order: str, start: list[int], limit: int = 1000) -> DataFrame:
    _one_of("order", order, ("by_comment_voter", "by_voter_comment"))
    if len(start) != 2:
        raise BadParameter("start has two numbers")
    if order == "by_comment_voter":
        return voting.votes_by_comment_voter(spark, sf_dir, *start, limit)
    return voting.votes_by_voter_comment(spark, sf_dir, *start, limit)


def follows_any_lists(spark: SparkSession, sf_dir: str, account: int) -> DataFrame:
    return graph.follows_any_lists(spark, sf_dir).where(F.col("account") == account).select("any_list")


def follow_count(spark: SparkSession, sf_dir: str, account: int) -> DataFrame:
    return graph.follow_counts(spark, sf_dir).where(F.col("account") == account)


def payout_stats(spark: SparkSession, sf_dir: str, limit: int = 250) -> DataFrame:
    return communities.payout_stats(spark, sf_dir).orderBy(F.col("payout").desc(), "community", F.col("author").asc_nulls_first()).limit(limit)


def unread(spark: SparkSession, sf_dir: str, account: int, read_until: str = "2024-01-15 00:00:00") -> DataFrame:
    return notices.unread_asof(spark, sf_dir, read_until).where(F.col("user_id") == account)


def muted_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bit, name) of the reasons for muting."""
    return spark.createDataFrame(list(bitmask.REASONS.items()), "bit int, name string")


@dataclass(frozen=True)
class Method:
    run: Callable[..., DataFrame]
    required: tuple[str, ...] = ()
    most: int = MOST_ROWS


_BRIDGE = {
    "get_ranked_posts": Method(get_ranked_posts, ("sort",)),
    "get_account_posts": Method(get_account_posts, ("sort", "account")),
    "get_account_posts_by_tag": Method(accounts.account_posts_by_tag, ("account", "tag")),
    "get_discussion": Method(threads.discussion_tree, ("post",), 2000),
    "get_post": Method(lookups.post, ("post",)),
    "get_post_header": Method(lookups.post_header, ("post",)),
    "get_profile": Method(accounts.profile_fields, ("accounts",)),
    "get_profiles": Method(accounts.profile_fields, ("accounts",)),
    "get_community": Method(communities.community, ("community",)),
    "get_community_context": Method(communities.community_context, ("community", "account")),
    "list_communities": Method(communities.communities_keyset),
    "list_pop_communities": Method(communities.pop_communities),
    "get_trending_topics": Method(communities.trending_topics),
    "list_subscribers": Method(communities.subscribers_roles, ("community",)),
    "list_community_roles": Method(communities.community_roles, ("community",)),
    "list_all_subscriptions": Method(communities.all_subscriptions, ("account",)),
    "get_payout_stats": Method(payout_stats, most=250),
    "account_notifications": Method(notices.account_notifications, ("account",)),
    "post_notifications": Method(notices.post_notifications, ("post",)),
    "unread_notifications": Method(unread, ("account",)),
    "get_relationship_between_accounts": Method(graph.relationship_flags, ("follower", "following")),
    "get_follow_list": Method(get_follow_list, ("account",)),
    "does_user_follow_any_lists": Method(follows_any_lists, ("account",)),
    "list_muted_reasons_enum": Method(muted_reasons),
}
_FOLLOW = {
    "get_followers": Method(graph.followers_page, ("account",), 1000),
    "get_following": Method(graph.following_page, ("account",), 1000),
    "get_follow_count": Method(follow_count, ("account",)),
    "get_blog": Method(accounts.account_blog, ("account",), 500),
    "get_blog_entries": Method(accounts.blog_entries, ("account",), 500),
    "get_reblogged_by": Method(lookups.reblogged_by, ("post",)),
    "get_account_reputations": Method(accounts.reputation_display, most=1000),
}
_CONDENSER = _FOLLOW | {
    "get_content": Method(lookups.post, ("post",)),
    "get_content_replies": Method(lookups.content_replies, ("post",), lookups.MOST_REPLIES),
    "get_active_votes": Method(voting.active_votes, ("post",), 1000),
    "get_trending_tags": Method(communities.trending_tags, most=250),
    "get_discussions_by_feed": Method(accounts.account_feed_month, ("account",)),
    "get_discussions_by_blog": Method(accounts.account_blog, ("account",)),
    "get_discussions_by_comments": Method(accounts.account_comments, ("account",)),
    "get_discussions_by_author_before_date": Method(accounts.account_posts_before, ("account", "before")),
    "get_replies_by_last_update": Method(accounts.account_replies, ("account",)),
    **{f"get_discussions_by_{sort}": Method(discussions(sort)) for sort in ("trending", "hot", "created")},
    "get_post_discussions_by_payout": Method(discussions("payout")),
    "get_comment_discussions_by_payout": Method(discussions("payout_comments")),
}
METHODS = {
    **{f"bridge.{n}": m for n, m in _BRIDGE.items()},
    **{f"condenser_api.{n}": m for n, m in _CONDENSER.items()},
    **{f"follow_api.{n}": m for n, m in _FOLLOW.items()},
    **{f"tags_api.{n}": m for n, m in _CONDENSER.items() if "discussions" in n or n in ("get_trending_tags", "get_content_replies")},
    "tags_api.get_discussion": _CONDENSER["get_content"],
    "database_api.list_votes": Method(list_votes, ("order", "start"), 1000),
    "database_api.find_votes": Method(voting.active_votes, ("post",), 1000),
    "database_api.find_comments": Method(lookups.find_comments, ("pairs",)),
    "search_api.find_text": Method(find_text, ("query",)),
    "hive.get_info": Method(lookups.info),
    "hive.db_head_state": Method(lookups.info),
    "rest.reblogs": Method(lookups.reblogged_by, ("post",)),
    "rest.operations": Method(notices.op_history, ("account",)),
}


def call(method: str, spark: SparkSession, sf_dir: str, params: dict | list | None = None) -> DataFrame:
    """Parameters by name or in order."""
    found = METHODS.get(method)
    if found is None:
        raise BadParameter(f"no such method: {method}")
    given = params or {}
    signature = inspect.signature(found.run)
    try:
        bound = signature.bind(spark, sf_dir, **given) if isinstance(given, dict) else signature.bind(spark, sf_dir, *given)
    except TypeError as e:
        raise BadParameter(f"{method}: {e}") from e
    for name in found.required:
        if name not in bound.arguments:
            raise BadParameter(f"{method}: {name} is missing")
    if "limit" in signature.parameters:
        limit = bound.arguments.setdefault("limit", min(found.most, signature.parameters["limit"].default or found.most))
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= found.most:
            raise BadParameter(f"{method}: limit must be from 1 to {found.most}")
    return found.run(**bound.arguments)

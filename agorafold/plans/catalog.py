"""The registered queries over social content and their DuckDB counterparts."""

from __future__ import annotations

from agorafold.operators import accounts, communities, fold_queries, graph, lookups, notices, notifications, places, ranked, search, sums, text_index, threads, upkeep, voting
from agorafold.plans import oracles

FLAGSHIP = "ranked_trending_all"

_BY_MODULE = {
    ranked: (
        "ranked_trending_all ranked_hot_all ranked_created_all ranked_payout_window ranked_payout_comments ranked_muted ranked_by_tag ranked_by_community "
        "ranked_my_hot ranked_my_lateral_topk ranked_pinned_two_tier keyset_page_two observer_mute_filter star_join_view ranked_without_reasons ranked_payout_roots"
    ),
    accounts: "account_posts account_replies account_payout account_feed account_feed_page_two account_blog account_blog_bridge account_comments account_posts_by_tag account_posts_before blog_entries account_info reputation_display profile_fields",
    voting: "vote_rollup active_votes votes_by_comment_voter votes_by_voter_comment vote_last_merge last_value_filter vote_value_score first_last_dedup latest_votes",
    communities: "payout_stats payout_totals community_rank communities_keyset pop_communities trending_tags trending_topics subscribers_roles community_roles all_subscriptions community community_context",
    graph: "follow_counts followers_page following_page follow_list follows_any_lists blacklist_listagg relationship_flags observer_mutes missing_accounts",
    threads: "discussion_tree children_counts muted_propagation",
    notices: "notification_ids notification_messages account_notifications post_notifications unread_asof block_lag op_history json_props muted_reason_mask",
    places: "post_places",
    sums: "vote_sums follow_sums",
    notifications: "notices_subscribe notices_reply notices_reblog notices_follow notices_mention notices_vote",
    search: "search_bm25 search_query search_page_two tag_normalise",
    text_index: "text_index_search text_index_terms",
    lookups: "post post_header content_replies reblogged_by find_comments posts_of_categories info changed_parents quiet_followers payouts_by_place",
    fold_queries: "fold_accounts fold_votes fold_posts fold_follows fold_reblogs fold_payouts fold_communities vote_notifications feed_entries",
    upkeep: "sequence_ids first_occurrences waves child_deltas retained_events next_orders post_mentions",
}


def queries() -> dict:
    return {name: getattr(module, name) for module, names in _BY_MODULE.items() for name in names.split()} | ranked.pairs() | search.searches()


def oracle_sql() -> dict[str, str]:
    pairs = {f"ranked_{sort}_{scope}": oracles.ranked_pair(sort, scope) for sort in ranked.SORTS for scope in ranked.SCOPES if (sort, scope) not in ranked.NAMED}
    return oracles.SQL | pairs

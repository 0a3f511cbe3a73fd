"""Every registered query over social content against its SQL counterpart."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from agorafold.plans import api, catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"select {quoted} from ({catalog.oracle_sql()[name]})").fetchall()
    rows = found.select(*columns).collect()
    assert sorted(tuple(map(_plain, r)) for r in rows) == sorted(tuple(map(_plain, r)) for r in expected)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_unconstrained_product(spark):
    for name in ("ranked_trending_all", "star_join_view", "vote_value_score", "account_feed"):
        plan = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    plan = catalog.queries()["ranked_trending_all"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_api_checks_parameters(spark):
    assert api.call("bridge.get_ranked_posts", spark, SF_DIR, {"sort": "created", "limit": 3}).count() == 3
    first = [r["id"] for r in api.call("bridge.get_ranked_posts", spark, SF_DIR, ["created"]).collect()]
    after = api.call("bridge.get_ranked_posts", spark, SF_DIR, {"sort": "created", "last": first[4], "limit": 5})
    assert [r["id"] for r in after.collect()] == first[5:10]
    bad = [
        ("bridge.nothing", {}), ("bridge.get_ranked_posts", {"sort": "best"}), ("bridge.get_ranked_posts", {"sort": "hot", "limit": 0}), ("bridge.get_ranked_posts", {"colour": 1}),
        ("bridge.get_ranked_posts", {"sort": "hot", "my": True}), ("bridge.get_ranked_posts", {"sort": "hot", "without": [9]}), ("bridge.get_post", {}), ("bridge.get_account_posts", {"sort": "posts"}),
        ("search_api.find_text", {"query": "--"}), ("database_api.list_votes", {"order": "by_comment_voter", "start": [1]}), ("condenser_api.get_followers", {"account": 1, "limit": 1001}),
    ]
    for method, params in bad:
        with pytest.raises(api.BadParameter):
            api.call(method, spark, SF_DIR, params)


#: Two sets of parameters for each method that takes any, and SQL for their rows' ids.
POST_SQL = "select o_orderkey, o_custkey, o_orderdate from orders where o_orderkey % 50 <> 7"
CALLS = [
    ("bridge.get_account_posts", {"sort": "posts", "account": 7}, f"select o_orderkey from ({POST_SQL}) where o_custkey = 7 and o_orderkey % 10 = 0 order by 1 desc limit 20", "id"),
    ("bridge.get_account_posts", {"sort": "comments", "account": 11, "limit": 3}, f"select o_orderkey from ({POST_SQL}) where o_custkey = 11 and o_orderkey % 10 <> 0 order by 1 desc limit 3", "id"),
    ("bridge.get_post_header", {"post": 12}, "select 12", "id"),
    ("bridge.get_post", {"post": 7}, "select 1 where false", "id"),
    ("condenser_api.get_content_replies", {"post": 1}, f"select o_orderkey from ({POST_SQL}) where o_orderkey % 10 <> 0 and o_orderkey // 3 = 1", "id"),
    ("condenser_api.get_content_replies", {"post": 5, "limit": 1}, f"select o_orderkey from ({POST_SQL}) where o_orderkey % 10 <> 0 and o_orderkey // 3 = 5 order by 1 limit 1", "id"),
    ("condenser_api.get_active_votes", {"post": 2}, "select distinct l_suppkey from lineitem where l_orderkey = 2", "voter"),
    ("database_api.find_votes", {"post": 33}, "select distinct l_suppkey from lineitem where l_orderkey = 33", "voter"),
    ("database_api.find_comments", {"pairs": [[0, 0], [0, 0]]}, "select 1 where false", "id"),
    ("follow_api.get_following", {"account": 2, "limit": 5}, "select distinct c_name from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where l_returnflag = 'A' and l_suppkey = 2 order by 1 limit 5", "name"),
    ("bridge.get_profile", {"accounts": [3, 9]}, "select c_custkey from customer where c_custkey in (3, 9)", "account"),
    ("bridge.get_community", {"community": 3}, "select 3", "community"),
    ("bridge.list_all_subscriptions", {"account": 9}, "select c_nationkey from customer where c_custkey = 9", "community"),
    ("bridge.list_communities", {"query": "nations 3", "last_rank": 0}, "select n_nationkey from nation where n_name = 'NATION_3'", "community"),
    ("hive.get_info", {}, "select max(o_orderkey) from orders", "last_id"),
    ("rest.operations", {"account": 4, "page": 1, "size": 3}, "select event_id from events where user_id = 4 order by 1 desc limit 3", "event_id"),
]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize(("method", "params", "sql", "column"), CALLS, ids=[f"{i}-{c[0]}" for i, c in enumerate(CALLS)])
def test_methods_answer_for_their_parameters(spark, duck, method, params, sql, column):
    found = [r[column] for r in api.call(method, spark, SF_DIR, params).collect()]
    assert sorted(found) == sorted(r[0] for r in duck.sql(sql).fetchall())


PAGED = [
    ("bridge.get_ranked_posts", {"sort": "created"}), ("bridge.get_ranked_posts", {"sort": "payout_comments"}), ("bridge.get_account_posts", {"sort": "feed", "account": 3}), ("bridge.get_account_posts", {"sort": "replies", "account": 7}),
    ("bridge.get_account_posts", {"sort": "comments", "account": 7}), ("condenser_api.get_discussions_by_feed", {"account": 3}),
]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize(("method", "params"), PAGED, ids=[f"{i}-{m}" for i, (m, _) in enumerate(PAGED)])
def test_second_pages_follow_first_ones(spark, method, params):
    whole = [r["id"] for r in api.call(method, spark, SF_DIR, params | {"limit": 6}).collect()]
    if len(whole) < 2:
        pytest.skip("one row only")
    half = len(whole) // 2
    first = [r["id"] for r in api.call(method, spark, SF_DIR, params | {"limit": half}).collect()]
    second = [r["id"] for r in api.call(method, spark, SF_DIR, params | {"limit": len(whole) - half, "last": first[-1]}).collect()]
    assert first + second == whole


def test_plans_join_by_keys(spark):
    for name in ("payouts_by_place", "observer_mutes", "find_comments"):
        plan = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and ("BroadcastNestedLoopJoin" not in plan or name == "payouts_by_place" and "Cross" in plan), name


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
def test_every_method_can_be_called(spark):
    known = {
        "sort": "created", "account": 7, "post": 1, "community": 7, "accounts": [7], "follower": 3, "following": 1, "tag": "Brand#13", "before": "1999-01-01", "query": "the", "pairs": [[1, 1]],
        "order": "by_voter_comment", "start": [3, 0],
    }
    for name, method in api.METHODS.items():
        given = {p: known[p] for p in method.required} | ({"sort": "posts"} if name == "bridge.get_account_posts" else {})
        assert api.call(name, spark, SF_DIR, given).columns, name

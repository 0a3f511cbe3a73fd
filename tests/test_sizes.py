"""Queries and expressions where sizes or values beyond the given tables change the result."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from agorafold.functions import ranking
from agorafold.operators import fold_queries, folds, places, sums
from agorafold.plans import catalog
from agorafold.sources import oplog, sinks


def _written(folder, **tables):
    """A folder of tables, each from a SELECT."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.sql(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


def test_communities_with_many_moderators(spark, tmp_path):
    """a nation of 240 suppliers has 120 moderators; beyond 100 the query left them out."""
    folder, con = _written(
        tmp_path, nation="select n::int as n_nationkey, 'N' || n as n_name from range(2) t(n)", customer="select n as c_custkey, (n % 2)::int as c_nationkey from range(7) t(n)",
        supplier="select n as s_suppkey, (n // 240)::int as s_nationkey from range(250) t(n)",
    )
    found = catalog.queries()["fold_communities"](spark, folder).collect()
    expected = con.sql(catalog.oracle_sql()["fold_communities"])
    assert sorted(tuple(r[c] for c in expected.columns) for r in found) == sorted(expected.fetchall())


@pytest.mark.parametrize("value", [0.26499999999999996, 146.32499999999996, 2249.6049999999996, 409.30394602625097, 1234.5, 12345.674999999999, 490719.69, 0.005, 0.02])
def test_payload_rounds_as_sql_does(spark, value):
    """half cents that binary fractions miss by less than 1e-12 were rounded down."""
    found = spark.range(1).select(ranking.vote_payload(F.lit(value))).first()[0]
    expected = duckdb.sql(f"select case when v < 0.01 then '' else '($' || round(v::varchar::decimal(30,12), 2)::decimal(30,2) || ')' end from (select {value!r}::double as v)").fetchall()[0][0]
    assert found == expected


def test_feed_goes_beyond_a_month(spark, tmp_path):
    """posts older than a month were left out."""
    folder, con = _written(
        tmp_path, customer="select n as c_custkey, 'C' || n as c_name, 0::int as c_nationkey, 1.0::double as c_acctbal from range(3) t(n)",
        orders="select n * 10 as o_orderkey, n % 3 as o_custkey, 'O' as o_orderstatus, 1.0::double as o_totalprice, timestamp '2000-01-01' + to_days((n * 40)::int) as o_orderdate, 'x' as o_orderpriority from range(9) t(n)",
        lineitem="select 10 as l_orderkey, 3 as l_suppkey, 'A' as l_returnflag, 1.0::double as l_quantity",
    )
    found = catalog.queries()["account_feed"](spark, folder).collect()
    assert [r["id"] for r in found] == [70, 40, 10]
    assert [tuple(r) for r in found] == con.sql(f"select id, first_at, names from ({catalog.oracle_sql()['account_feed']}) order by 2 desc, 1 desc").fetchall()


def test_suppliers_follow_all_lists_of_their_nation(spark, tmp_path):
    """F4 to F7: each followed two lists only."""
    folder, con = _written(
        tmp_path, customer="select n as c_custkey, 'C' || n as c_name, (n % 2)::int as c_nationkey, 1.0::double as c_acctbal from range(40) t(n)",
        supplier="select n as s_suppkey, case when n < 300 then (n // 100)::int end as s_nationkey from range(303) t(n)",
        orders="select n as o_orderkey, n % 40 as o_custkey, 'O' as o_orderstatus, 1.0::double as o_totalprice, timestamp '2000-01-01' as o_orderdate, 'x' as o_orderpriority from range(60) t(n)",
        lineitem="select n % 60 as l_orderkey, case when n < 180 then n % 90 * 2 when n = 180 then 250 else n end as l_suppkey, case when n % 7 = 0 or n % 60 % 40 < 10 then 'A' else 'R' end as l_returnflag, 46.0::double as l_quantity from range(305) t(n) where n <= 180 or n > 300",
    )
    for name in ("follows_any_lists", "relationship_flags", "observer_mutes", "discussion_tree"):
        found = catalog.queries()[name](spark, folder)
        expected = con.sql(f"select {', '.join(found.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
        assert expected, name
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected)), name
    lists = dict(con.sql(f"select account, any_list from ({catalog.oracle_sql()['follows_any_lists']})").fetchall())
    assert lists[99] and not lists[250] and not lists[301]
    pairs = con.sql(f"select count(*) from ({catalog.oracle_sql()['relationship_flags']}) where follows_muted").fetchall()
    assert pairs[0][0] > 2 * 303


def _joins_by_nation(rows) -> list[str]:
    """The joins in a plan of rows that were made once for each part of their nation."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "__to" in line]


def _mute_tables(folder):
    """Customers whose keys are those of lists too, so that suppliers follow or mute a list by both relations; two suppliers of two nations, one that comes twice, one without a key."""
    return _written(
        folder, customer="select n as c_custkey, 'C' || n as c_name, (n % 2)::int as c_nationkey, 1.0::double as c_acctbal from range(40) t(n)",
        supplier="select n as s_suppkey, (n // 30)::int as s_nationkey from range(60) t(n) union all values (3, 1::int), (3, 1::int), (4, 1::int), (5, null::int), (null, 1::int)",
        orders="select n as o_orderkey, n % 40 as o_custkey, 'O' as o_orderstatus, 1.0::double as o_totalprice, timestamp '2000-01-01' as o_orderdate, 'x' as o_orderpriority from range(60) t(n)",
        lineitem="select n * 7 % 60 as l_orderkey, n * 3 % 50 as l_suppkey, case when n % 3 = 0 then 'A' else 'R' end as l_returnflag, 46.0::double as l_quantity from range(300) t(n)",
    )


def test_pairs_of_relations_are_neither_broadcast_nor_grouped(spark, tmp_path):
    """suppliers times parts of their nations were broadcast, and all pairs of suppliers and lists were grouped."""
    folder, con = _mute_tables(tmp_path)
    found = catalog.queries()["relationship_flags"](spark, folder)
    joins = _joins_by_nation(found)
    assert joins and all("SortMergeJoin" in j for j in joins)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("__to")]
    expected = con.sql(f"select {', '.join(found.columns)} from ({catalog.oracle_sql()['relationship_flags']})").fetchall()
    rows = [tuple(r) for r in found.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, expected))
    both = [r for r in found.collect() if r["follows_muted"] and (r["follows"] or r["ignores"])]
    assert both and any({r["follower"], r["following"]} == {3, 4} and r["follows_muted"] for r in found.collect())
    one = found.where("follower = 3 and follows_muted").count()
    assert catalog.queries()["relationship_flags"](spark, folder, follower=3).where("follows_muted").count() == one > 0


def test_mutes_of_nations_are_not_broadcast(spark, tmp_path):
    """suppliers times parts of their nations were broadcast."""
    folder, _ = _mute_tables(tmp_path)
    joins = _joins_by_nation(catalog.queries()["observer_mutes"](spark, folder))
    assert joins and all("SortMergeJoin" in j for j in joins)


def test_bodies_are_parsed_once_and_first_batches_join_nothing(spark):
    """six parses of each body, and joins of a first batch with a state that is empty."""
    log = spark.createDataFrame([], oplog.SCHEMA)
    plan = lambda fold, schema: fold(sinks.nothing(spark, schema), log)._jdf.queryExecution().optimizedPlan().toString()
    votes, posts = plan(folds.fold_votes, folds.VOTES), plan(folds.fold_posts, folds.POSTS)
    assert votes.count("from_json") == 1 and "Join" not in votes
    assert "get_json_object(body" not in votes + posts


def test_sums_change_by_touched_rows_alone(spark):
    """an older part that came again had all rows of both states compared."""
    row = lambda voter, rshares, block: (voter, "a", "p", None, rshares, 0, None, 0, True, block)
    before = spark.createDataFrame([row("x", 1, 3), row("y", 2, 9), row("z", 4, 9)], folds.VOTES)
    after = spark.createDataFrame([row("x", 7, 5), row("y", 2, 9), row("z", 4, 9), row("w", 8, 4)], folds.VOTES)
    every = sums.vote_deltas(before, after).collect()
    assert sums.vote_deltas(sums.touched(before, 5), sums.touched(after, 5)).collect() == every
    assert sums.touched(after, 5).count() == 2 and sums.touched(after, None).count() == 4


def test_a_name_like_that_of_an_older_post(spark):
    """posts were told apart by texts; an older generation had the same one as a post named so. A batch that came again moved all posts once more."""
    made = lambda permlink, generation, block, parent="": ("ann", permlink, generation, "ann" if parent else "", parent or "hive-100001", block)
    posts = spark.createDataFrame([made("p", 0, 1), made("p", 1, 2), made("p#0", 0, 3), made("r", 0, 4, "p#0")], "author string, permlink string, generation int, parent_author string, parent_permlink string, created_block int")
    op = lambda i, permlink: (i, i, datetime.datetime(2020, 1, 1), oplog.TYPES["comment"], json.dumps({"author": "ann", "permlink": permlink}))
    log = spark.createDataFrame([op(1, "p"), op(2, "p"), op(3, "p#0"), op(4, "r")], oplog.SCHEMA)
    known = sinks.nothing(spark, folds.COMMUNITIES)
    once = places.fold_places(sinks.nothing(spark, places.PLACES), posts, log, known)
    assert sorted((r["permlink"], r["generation"], r["root_permlink"], r["depth"]) for r in once.collect()) == [("p", 0, "p", 0), ("p", 1, "p", 0), ("p#0", 0, "p#0", 0), ("r", 0, "p#0", 1)]
    state = sinks.Shared(spark, "test").keep(once)
    assert places.fold_places(state, posts, log, known) is state


def _kept(monkeypatch) -> list[list[str]]:
    """The columns of each table that is kept from now on."""
    seen, keep = [], sinks.Shared.keep
    monkeypatch.setattr(sinks.Shared, "keep", lambda self, rows: seen.append(rows.columns) or keep(self, rows))
    return seen


def test_feed_keeps_its_log_once(spark, monkeypatch):
    """the log was written twice, and texts went through the last fold."""
    seen = _kept(monkeypatch)
    fold_queries.feed_entries(spark, "/root/testdata/sf0.001")
    assert sum("op_type" in c for c in seen) == 1
    assert "body" not in [c for c in seen if "permlink" in c and "account" not in c][-1]

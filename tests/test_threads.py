"""Threads without a cap on rows or levels."""

import os

import pytest

from agorafold.operators import threads
from agorafold.plans import catalog
from agorafold.sources import sinks

SF_DIR = "/root/testdata/sf0.001"
NODES = "id long, parent long, marked boolean"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", ["children_counts", "muted_propagation", "discussion_tree"])
def test_more_rows_than_recursion_may_have(spark, name):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        assert catalog.queries()[name](spark, SF_DIR).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_thread_deeper_than_300(spark, monkeypatch):
    """A chain of 700 posts, the 400th marked, with a reply beside it at each tenth, and one whose parent is missing."""
    rows = [(i, i - 1 if i else None, i == 400) for i in range(700)] + [(1000 + i, i, False) for i in range(0, 700, 10)] + [(5000, 4999, False)]
    nodes = spark.createDataFrame(rows, NODES)
    monkeypatch.setattr(threads, "LEVELS", 3)
    depth = {r["id"]: r["depth"] for r in threads.descend(nodes, 5).collect()}
    assert depth == {i: i - 5 for i in range(5, 700)} | {1000 + i: i - 4 for i in range(10, 700, 10)}
    below = {r["id"]: r["n"] for r in threads.descendants(nodes).collect()}
    assert below == {i: 699 - i + 70 - (i + 9) // 10 for i in range(700)} | {1000 + i: 0 for i in range(0, 700, 10)} | {5000: 0}
    heirs = sorted(r["heir"] for r in threads.heirs(nodes).collect())
    assert heirs == [*range(401, 700), *range(1400, 1700, 10)]
    new = spark.createDataFrame([(1050,), (699,)], "id long")
    assert {r["id"]: r["n"] for r in threads.gained(nodes, new).collect()} == {i: 2 if i <= 50 else 1 for i in range(699)}


def test_levels_limits_and_gains(spark, monkeypatch):
    """A tree of 40 nodes by threes: a limit takes whole levels, who isn't shown vanishes with all below, few new nodes raise their ancestors."""
    nodes = spark.createDataFrame([(i, (i - 1) // 3 if i else None, i == 2) for i in range(40)], NODES)
    depth = {0: 0} | {i: 1 for i in range(1, 4)} | {i: 2 for i in range(4, 13)} | {i: 3 for i in range(13, 40)}
    for broadcasts in (threads.FRONT_ROWS, 0):
        monkeypatch.setattr(threads, "FRONT_ROWS", broadcasts)
        assert {r["id"]: r["depth"] for r in threads.descend(nodes, 0).collect()} == depth
        assert {r["id"] for r in threads.descend(nodes, 0, limit=5).collect()} == set(range(13))
        kept = {r["id"] for r in threads.descend(nodes, 0, shown=lambda level: level.where("not marked")).collect()}
        assert kept == {i for i in range(40) if i != 2 and (i - 1) // 3 != 2 and ((i - 1) // 3 - 1) // 3 != 2}
        assert {r["id"]: r["n"] for r in threads.gained(nodes, spark.createDataFrame([(39,), (38,), (5,)], "id long")).collect()} == {0: 3, 1: 1, 3: 2, 12: 2}


def test_rounds_over_all_posts_broadcast_nothing(spark, monkeypatch):
    """each round's join broadcast all posts, as their compressed files are small."""
    plans, keep = [], sinks.Shared.keep
    monkeypatch.setattr(sinks.Shared, "keep", lambda self, rows: plans.append(rows) or keep(self, rows))
    rows = [(i, (i - 1) // 3 if i else None, i == 2) for i in range(40)]
    nodes = spark.createDataFrame(rows, NODES)
    for count in (threads.descendants, threads.depths, threads.tops, threads.heirs):
        plans.append(count(nodes))
    if os.path.isdir(SF_DIR):
        plans.append(threads.children_counts(spark, SF_DIR))
    assert len(plans) > 12
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]

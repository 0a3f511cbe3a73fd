"""Discussion trees: expansion, descendant counts, inherited mutes.

One thread, and the ancestors of some new posts, are followed level by level,
so that only they move.  What concerns all posts uses pointer doubling in place
of recursion: one row a post and round, whatever the
depth, so neither levels nor rows are capped; rows shuffle on ids and no tree
is held in one task.  The files of a round are compressed to a few bytes a row,
so Spark would broadcast millions of rows by their size; joins of all posts ask
for a merge.  Parents that aren't among the posts end a thread.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.operators import graph
from agorafold.sources import sinks, tables

OBSERVER, ROOT = 1, 0
#: Ids of a level that are broadcast.
FRONT_ROWS = 500_000
#: Levels that are followed one by one.
LEVELS = 32
TYPE_BIT, PARENT_BIT, REPUTATION_BIT = 1 << 1, 1 << 2, 1 << 3


def _doubled(nodes: DataFrame, widen: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``nodes`` (id, up, ...) with what they gather from all distances; ``up`` is the parent at first.

    A round takes the ancestor 2 * reach above for the one reach above
    (pointer doubling), so a thread of depth d takes log2(d) rounds, each of
    one row a post.  The rows of a round are written to the shared folder.
    """
    shared = sinks.Shared(nodes.sparkSession, "threads")
    now, reach = shared.keep(nodes), 1
    most = now.count()
    while reach < most and now.where("up IS NOT NULL").limit(1).count():
        last, now = now, shared.keep(widen(now, reach))
        shared.drop(last)
        reach *= 2
    return now


def _climbed(now: DataFrame, found: str) -> tuple[DataFrame, DataFrame]:
    """The nodes that have ``up``, with its (next, of_up); the other nodes."""
    above = now.select(F.col("id").alias("a"), F.col("up").alias("next"), F.col(found).alias("of_up"))
    climbing = now.where("up IS NOT NULL")
    return climbing.join(above.hint("merge"), climbing.up == above.a, "left"), now.where("up IS NULL")


def descendants(nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, n): how many of (id, parent) are below each node, or the sum of their weights."""

    def widen(now: DataFrame, reach: int) -> DataFrame:
        # n counts the nodes at distances under reach; those up to 2 * reach are so far below the ones at reach.
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("of")).agg(F.sum("n").alias("more"))
        climbing, rest = _climbed(now, "n")
        moved = climbing.select("id", F.col("next").alias("up"), "n").unionByName(rest)
        return moved.join(below.hint("merge"), moved.id == below.of, "left").select("id", "up", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))

    own = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    nodes = nodes.select("id", "parent", own.alias("n"))
    counted = _doubled(nodes.select("id", F.col("parent").alias("up"), "n"), widen)
    if weight is None:
        return counted.select("id", (F.col("n") - 1).alias("n"))
    return counted.join(nodes.select(F.col("id").alias("i"), F.col("n").alias("w")).hint("merge"), F.col("id") == F.col("i")).select("id", (F.col("n") - F.col("w")).alias("n"))


def depths(nodes: DataFrame) -> DataFrame:
    """(id, depth) of each of (id, parent): 0 without a parent; a parent that isn't there counts."""

    def widen(now: DataFrame, reach: int) -> DataFrame:
        climbing, rest = _climbed(now, "depth")
        moved = climbing.select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("of_up", F.lit(0))).alias("depth"))
        return moved.unionByName(rest)

    return _doubled(nodes.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("depth")), widen).select("id", "depth")


def tops(nodes: DataFrame) -> DataFrame:
    """(id, top, depth): of each of (id, parent) the farthest ancestor among the nodes, itself without one, and how far it is."""
    held = nodes.select(F.col("id").alias("p"))
    inside = nodes.join(held.hint("merge"), nodes.parent == held.p, "left").select("id", F.col("p").alias("up"), F.coalesce("p", "id").alias("top"), F.when(F.col("p").isNotNull(), 1).otherwise(0).alias("depth"))

    def widen(now: DataFrame, reach: int) -> DataFrame:
        above = now.select(F.col("id").alias("a"), F.col("up").alias("next"), F.col("top").alias("far"), F.col("depth").alias("more"))
        moved = now.where("up IS NOT NULL").join(above.hint("merge"), F.col("up") == F.col("a")).select("id", F.col("next").alias("up"), F.col("far").alias("top"), (F.col("depth") + F.col("more")).alias("depth"))
        return moved.unionByName(now.where("up IS NULL"))

    return _doubled(inside, widen).select("id", "top", "depth")


def heirs(nodes: DataFrame) -> DataFrame:
    """(heir): the nodes of (id, parent, marked) that have a marked ancestor."""

    def widen(now: DataFrame, reach: int) -> DataFrame:
        climbing, rest = _climbed(now, "marked")
        moved = climbing.select("id", F.col("next").alias("up"), F.coalesce("of_up", F.lit(False)).alias("marked"))
        return moved.select("id", F.when(~F.col("marked"), F.col("up")).alias("up"), "marked").unionByName(rest)

    marked = F.coalesce("marked", F.lit(False))
    start = nodes.select("id", F.when(~marked, F.col("parent")).alias("up"), marked.alias("marked"))
    under = _doubled(start, widen).where("marked").select(F.col("id").alias("above"))
    return nodes.join(under.hint("merge"), nodes.parent == under.above, "left_semi").select(F.col("id").alias("heir"))


def _front(rows: DataFrame) -> DataFrame:
    """For a broadcast where few rows have been counted, else for a merge."""
    return F.broadcast(rows) if rows.count() <= FRONT_ROWS else rows.hint("merge")


def _below(nodes: DataFrame, fronts: DataFrame) -> DataFrame:
    """(id, depth) of some nodes (id, depth) and all below them, by pointer doubling over all (id, parent)."""

    def widen(now: DataFrame, reach: int) -> DataFrame:
        climbing, rest = _climbed(now, "depth")
        moved = climbing.select("id", F.col("next").alias("up"), (F.col("of_up") + reach).alias("depth"))
        return moved.select("id", F.when(F.col("depth").isNull(), F.col("up")).alias("up"), "depth").unionByName(rest)

    placed = nodes.join(_front(fronts.select(F.col("id").alias("f"), F.col("depth").alias("of"))), F.col("id") == F.col("f"), "left")
    start = placed.select("id", F.when(F.col("f").isNull(), F.col("parent")).alias("up"), F.col("of").alias("depth"))
    return _doubled(start, widen).where("depth IS NOT NULL").select("id", "depth")


def descend(nodes: DataFrame, root: int, limit: int | None = None, shown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, depth, ...) of a root and all below it within (id, parent, ...), level by level from the root.

    A level is found from the one before, whose ids are all that moves; what
    ``shown`` leaves out of a level vanishes with all below.  Whole levels are
    taken until there are ``limit`` rows, so the nearest are all there.  What
    lies deeper than ``LEVELS`` comes from pointer doubling.
    """
    shared = sinks.Shared(nodes.sparkSession, "threads")
    shown = shown or (lambda level: level)
    level = shared.keep(shown(nodes.where(F.col("id") == int(root)).withColumn("depth", F.lit(0))))
    found, total = level, level.count()
    for depth in itertools.count(1):
        if level.limit(1).count() == 0 or (limit is not None and total >= limit):
            return found
        if depth > LEVELS:
            rest = _below(shown(nodes.where(F.col("id") != int(root))), level.select("id", "depth")).where(F.col("depth") >= depth)
            return found.unionByName(nodes.join(rest.withColumnRenamed("id", "i").hint("merge"), F.col("id") == F.col("i")).drop("i").select(*found.columns))
        above = _front(level.select(F.col("id").alias("up")))
        below = nodes.where(F.col("id") != int(root)).join(above, F.col("parent") == F.col("up"), "left_semi")  # the root may be below itself
        level = shared.keep(shown(below.withColumn("depth", F.lit(depth))))
        found, total = found.unionByName(level), total + level.count()


def gained(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """(id, n): by how many descendants some new nodes (id) raise the counts of those above them in (id, parent).

    Only the new nodes and then their ancestors move, a level a round; the
    other nodes are read, not moved.  Trees deeper than ``LEVELS`` above them
    are counted by pointer doubling over all.
    """
    shared = sinks.Shared(nodes.sparkSession, "gained")

    def above(rows: DataFrame) -> DataFrame:
        held = _front(rows.select(F.col("id").alias("at"), "n"))
        climbed = nodes.where("parent IS NOT NULL").join(held, F.col("id") == F.col("at")).groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("n"))
        return shared.keep(climbed)

    now = above(new.select("id", F.lit(1).cast("long").alias("n")))
    total = now
    for _ in range(LEVELS):
        if now.limit(1).count() == 0:
            break
        now = above(now)
        total = total.unionByName(now)
    else:
        fresh = new.select(F.col("id").alias("f"), F.lit(1).cast("long").alias("w"))
        weighed = nodes.join(fresh, F.col("id") == F.col("f"), "left").select("id", "parent", F.coalesce("w", F.lit(0)).alias("weight"))
        return descendants(weighed, "weight").where("n > 0")
    sums = total.groupBy("id").agg(F.sum("n").alias("n"))
    return sums.join(nodes.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_semi")


def discussion_tree(spark: SparkSession, sf_dir: str, post: int = ROOT, observer: int = OBSERVER, limit: int | None = None) -> DataFrame:
    """A thread with each post's replies; who the observer mutes vanishes with all below.

    ``limit``: posts nearest to the root, for callers with a page to fill.
    """
    muted = sinks.Shared(spark, "muted").keep(graph.muted_by(spark, sf_dir, observer, tables.followed_mute_lists))
    rows = descend(tables.links(spark, sf_dir), post, limit, lambda level: level.join(muted, F.col("author") == F.col("muted"), "left_anti"))
    rows = rows if limit is None else rows.orderBy("depth", "id").limit(limit)
    replies = rows.where("depth > 0").groupBy(F.col("parent").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("replies"))
    return rows.join(replies, rows.id == replies.of, "left").select("id", "author", "depth", F.coalesce("replies", F.lit("")).alias("replies"))


def children_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of every live post, counting live ones."""
    links, authors = tables.links(spark, sf_dir), tables.read(spark, sf_dir, "customer").select("c_custkey").hint("merge")
    live = links.join(authors, links.author == authors.c_custkey, "left").select("id", "parent")
    return descendants(live).select("id", F.col("n").alias("children"))


def muted_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for muting: own ones, and the parent's bit where any ancestor is muted."""
    own = F.when(F.col("grayed"), REPUTATION_BIT).otherwise(0).bitwiseOR(F.when(F.col("community") % 7 == 0, TYPE_BIT).otherwise(0))
    nodes = tables.posts(spark, sf_dir).select("id", "parent", own.alias("own"))
    inherits = heirs(nodes.select("id", "parent", (F.col("own") != 0).alias("marked")))
    joined = nodes.join(inherits, nodes.id == inherits.heir, "left")
    return joined.select("id", F.col("own").bitwiseOR(F.when(F.col("heir").isNotNull(), PARENT_BIT).otherwise(0)).alias("reasons"))

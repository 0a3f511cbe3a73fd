"""Where posts stand: root, depth and community of each, and why it is muted from the start.

A table of places is kept by batch.  A new post's chain of parents is followed
among the batch's new posts only (pointer doubling over these), and from the
topmost of them into the table, so a batch costs what it brings.  The author's
role is the one at the post's operation: posts and role changes are put in
order by community and account, and the last role before a post is taken.  A
community with most of the posts is spread by author.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.functions import rules, text
from agorafold.operators import folds, threads
from agorafold.sources import fixture_log, oplog, sinks

PLACES = "author string, permlink string, generation int, root_author string, root_permlink string, depth int, community string, reasons int"
_KEY = ["author", "permlink", "generation"]


def roles_at(posts: DataFrame, roles: DataFrame) -> DataFrame:
    """``posts`` (community, author, op_id, ...) with ``rank``, the author's role there at that operation; 0 without one.

    roles: (community, account, op_id, rank), as ``folds.community_roles`` gives them.
    """
    shown = posts.withColumn("rank", F.lit(None).cast("int")).withColumn("__is_post", F.lit(True))
    given = roles.select("community", F.col("account").alias("author"), "op_id", "rank").withColumn("__is_post", F.lit(False))
    before = Window.partitionBy("community", "author").orderBy("op_id", "__is_post").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shown.unionByName(given, allowMissingColumns=True).withColumn("rank", F.coalesce(F.last("rank", ignorenulls=True).over(before), F.lit(0)))
    return placed.where("__is_post").drop("__is_post")


def _new_posts(state: DataFrame, posts: DataFrame, log: DataFrame) -> DataFrame:
    """Posts that have no place yet, with the operation that made them and whether they are the latest of their name."""
    new = posts.join(state.select(*_KEY), _KEY, "left_anti")
    comments = oplog.scan(log, types=("comment",)).select(oplog.field("author").alias("author"), oplog.field("permlink").alias("permlink"), F.col("block_num").alias("created_block"), "op_id")
    made = comments.groupBy("author", "permlink", "created_block").agg(F.min("op_id").alias("op_id"))
    rows = new.join(made, ["author", "permlink", "created_block"])
    latest = F.max("generation").over(Window.partitionBy("author", "permlink")) == F.col("generation")
    is_root = F.coalesce("parent_author", F.lit("")) == ""
    return rows.select(*_KEY, "parent_author", "parent_permlink", "op_id", latest.alias("is_latest"), is_root.alias("is_root"))


def _linked(new: DataFrame) -> DataFrame:
    """(id, parent) of new posts by their numbers; parent is null for roots and under what isn't new. Replies hang on the latest generation of a post."""
    heads = new.where("is_latest").select(F.col("author").alias("parent_author"), F.col("permlink").alias("parent_permlink"), F.col("id").alias("parent"))
    replies = new.where("not is_root").select("id", "parent_author", "parent_permlink").join(heads, ["parent_author", "parent_permlink"], "left").select("id", "parent")
    return replies.unionByName(new.where("is_root").select("id", F.lit(None).cast("long").alias("parent")))


def fold_places(state: DataFrame, posts: DataFrame, log: DataFrame, communities: DataFrame) -> DataFrame:
    """The table with the places of the posts that a batch brings.

    posts: their state after the batch; communities: theirs before it.  A batch
    that comes again brings no new posts.  Under a parent that isn't known a
    post starts a thread without a community.  New posts are numbered as they
    are written, so that the rounds along their threads move numbers only.
    """
    shared = sinks.Shared(state.sparkSession, "places")
    new = shared.keep(_new_posts(state, posts, log).withColumn("id", F.monotonically_increasing_id()))
    if new.isEmpty():
        return state
    links = shared.keep(_linked(new))
    tops = threads.tops(links)
    of_top = new.join(tops.where("id = top").select("id"), "id", "left_semi").select(F.col("id").alias("top"), F.col("author").alias("ta"), F.col("permlink").alias("tp"), "is_root", "parent_author", F.col("parent_permlink").alias("named"))
    latest = state.groupBy("author", "permlink").agg(F.max_by(F.struct("root_author", "root_permlink", "depth", "community", "reasons"), "generation").alias("of"))
    latest = latest.select(F.col("author").alias("known_author"), F.col("permlink").alias("known"), "of")
    under = ~F.col("is_root") & (F.col("parent_author") == F.col("known_author")) & (F.col("named") == F.col("known"))
    ends = of_top.join(latest, under, "left").select(
        "top", F.coalesce("of.root_author", "ta").alias("root_author"), F.coalesce("of.root_permlink", "tp").alias("root_permlink"), F.coalesce(F.col("of.depth") + 1, F.lit(0)).alias("above"),
        F.when(F.col("is_root") & text.is_community(F.col("named")), F.col("named")).otherwise(F.col("of.community")).alias("community"), (F.coalesce("of.reasons", F.lit(0)) != 0).alias("under_muted"),
    )
    placed = new.select(*_KEY, "id", "op_id", "is_root").join(links, "id").join(tops, "id").join(ends, "top").withColumn("under_muted", F.col("under_muted") & (F.col("id") == F.col("top"))).drop("top")
    _, roles = folds.community_roles(communities, log)
    judged = roles_at(placed, roles)
    by_type = rules.muted_reasons(F.col("is_root"), text.community_type(F.col("community")), F.col("rank"), F.col("under_muted"))
    depth = (F.col("above") + F.col("depth")).cast("int").alias("depth")
    judged = shared.keep(judged.select(*_KEY, "id", "parent", "root_author", "root_permlink", depth, "community", by_type.alias("reasons")))
    heirs = threads.heirs(judged.select("id", "parent", (F.col("reasons") != 0).alias("marked")))
    joined = judged.join(heirs, judged.id == heirs.heir, "left")
    reasons = F.col("reasons").bitwiseOR(F.when(F.col("heir").isNotNull(), F.lit(rules.PARENT_BIT)).otherwise(F.lit(0)))
    return state.unionByName(joined.select(*_KEY, "root_author", "root_permlink", "depth", "community", reasons.cast("int").alias("reasons")))


def post_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every post of a log made from the tables; the batch comes twice."""
    shared = sinks.Shared(spark, "post-places")
    empty = lambda schema: sinks.nothing(spark, schema)
    log = shared.keep(fixture_log.threads(spark, sf_dir).unionByName(fixture_log.places(spark, sf_dir)))
    posts = folds.fold_posts(empty(folds.POSTS), log)
    posts = shared.keep(posts.select(*_KEY, "parent_author", "parent_permlink", "created_block"))
    once = shared.keep(fold_places(empty(PLACES), posts, log, empty(folds.COMMUNITIES)))
    return fold_places(once, posts, log, empty(folds.COMMUNITIES)).drop("root_author")

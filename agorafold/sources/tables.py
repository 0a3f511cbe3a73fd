"""The content model over the given tables: posts, votes, tags, edges, accounts.

Orders stand for posts, line items for votes, customers for accounts, nations
for communities, brands for tags and suppliers for voters and followers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.functions import ranking


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, author, created, payout, paid, category, community, grayed, deleted, parent."""
    orders = read(spark, sf_dir, "orders")
    authors = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("grayed"))
    return orders.join(authors, orders.o_custkey == authors.c_custkey, "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("created"),
        F.col("o_totalprice").cast("decimal(10,3)").alias("payout"), (F.col("o_orderstatus") == "F").alias("paid"),
        F.col("o_orderpriority").alias("category"), F.col("c_nationkey").alias("community"), "grayed",
        (F.col("o_orderkey") % 50 == 7).alias("deleted"),
        F.when(F.col("o_orderkey") % 10 != 0, F.expr("o_orderkey div 3")).alias("parent"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent, author of live posts, without what else is known of them."""
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").where(key % 50 != 7)
    return rows.select(key.alias("id"), F.when(key % 10 != 0, F.expr("o_orderkey div 3")).alias("parent"), F.col("o_custkey").alias("author"))


def live_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where(~F.col("deleted"))


def roots(rows: DataFrame) -> DataFrame:
    """Posts of depth 0."""
    return rows.where(F.col("parent").isNull())


def replies(rows: DataFrame) -> DataFrame:
    """Posts of depth above 0."""
    return rows.where(F.col("parent").isNotNull())


def reblogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, post, at: who replies to a post shares it; its first reply counts."""
    shared = replies(live_posts(spark, sf_dir))
    return shared.groupBy(F.col("author").alias("account"), F.col("parent").alias("post")).agg(F.min("created").alias("at"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post, voter, rshares, effective, at."""
    rshares = F.round(F.col("l_extendedprice") * 100).cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("post"), F.col("l_suppkey").alias("voter"),
        F.when(F.col("l_returnflag") == "R", -rshares).otherwise(rshares).alias("rshares"),
        (F.col("l_linestatus") == "F").alias("effective"), F.col("l_shipdate").alias("at"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post, tag: distinct."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("post"), F.col("p_brand").alias("tag")).distinct()


def _edges(spark: SparkSession, sf_dir: str, flag: str, least: float = 0) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") >= least)).select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("l_suppkey").alias("follower"), F.col("o_custkey").alias("following")).distinct()


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "A")


def mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "R", 45)


def mute_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list, nation): suppliers who mute anyone, each once."""
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("list"), F.col("s_nationkey").alias("nation"))
    return known.join(mutes(spark, sf_dir).select(F.col("follower").alias("m")).distinct(), F.col("list") == F.col("m"), "left_semi")


def followed_mute_lists(spark: SparkSession, sf_dir: str, but: DataFrame | None = None) -> DataFrame:
    """Suppliers follow the mute lists of the others of their nation: those who mute anyone.

    Each pair once, also where a key has several nations.  Of one supplier its
    nation's lists; of all they grow with the square of a nation's suppliers,
    so what needs no pairs goes by nation, and pairs (follower, following) that
    are to be left out, ``but``, travel with the follower: the pairs never move.
    """
    left = _first_common(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("follower"), F.col("s_nationkey").alias("nation")), "follower", "before")
    left = left.withColumn("but", F.lit(None).cast("array<long>"))
    if but is not None:
        told = but.groupBy(F.col("follower").alias("f")).agg(F.collect_set("following").alias("told"))
        left = left.drop("but").join(told.hint("merge"), F.col("follower") == F.col("f"), "left").select("follower", "nation", "before", F.col("told").alias("but"))
    right = _first_common(mute_lists(spark, sf_dir), "list", "list_before").withColumnRenamed("nation", "of")
    pairs = by_nation(left, spread(right, "list")).where("follower <> list AND (before IS NULL OR list_before IS NULL OR NOT arrays_overlap(before, list_before))")
    return pairs.where("but IS NULL OR NOT array_contains(but, list)").select("follower", F.col("list").alias("following"))


def _first_common(rows: DataFrame, key: str, before: str) -> DataFrame:
    """(key, nation) once each, with the smaller nations of a key that has several: pairs met there before."""
    every = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("nation").alias("all")).withColumn("nation", F.explode("all"))
    return every.select(key, "nation", F.when(F.size("all") > 1, F.filter("all", lambda x: x < F.col("nation"))).alias(before))


#: Parts into which the rows of one nation are divided in joins by nation.
NATION_PARTS = 32


def spread(rows: DataFrame, by: str) -> DataFrame:
    """With the part of its nation that a row is in."""
    return rows.withColumn("__part", F.pmod(F.hash(by), F.lit(NATION_PARTS)))


def spread_to(rows: DataFrame) -> DataFrame:
    """Each row once for each part."""
    return rows.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(NATION_PARTS - 1))))


def by_nation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (nation, ...) with all spread rows (of, __part, ...) of their nation.

    Spark counts the rows that `spread_to` makes as one each and would
    broadcast them all, so this asks for a merge; and as few rows go in for
    those that come out, for all tasks that a shuffle may have.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = spread_to(left).repartition(tasks, "nation", "__to")
    return given.join(right.repartition(tasks, "of", "__part").hint("merge"), (F.col("nation") == F.col("of")) & (F.col("__to") == F.col("__part")))


def two_mute_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier follows the mute lists of two others, by their numbers, if those mute anyone."""
    k = F.col("s_suppkey")
    pairs = read(spark, sf_dir, "supplier").select(k.alias("follower"), F.explode(F.array_distinct(F.array(k % 97 + 1, k % 89 + 1))).alias("following")).where("follower <> following")
    return pairs.join(mutes(spark, sf_dir).select(F.col("follower").alias("m")).distinct(), F.col("following") == F.col("m"), "left_semi")


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each post: rshares, abs_rshares, total_votes (effective), net_votes."""
    return votes(spark, sf_dir).groupBy(F.col("post").alias("post")).agg(
        F.sum("rshares").alias("rshares"), F.sum(F.abs("rshares")).alias("abs_rshares"),
        F.count_if("effective").alias("total_votes"), F.sum(F.signum("rshares").cast("long")).alias("net_votes"),
    )


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live posts with their roll-up and both scores; without votes the sums are 0."""
    sums = rollup(spark, sf_dir)
    joined = live_posts(spark, sf_dir).join(sums, F.col("id") == sums.post, "left").drop("post")
    filled = joined.fillna(0, ["rshares", "abs_rshares", "total_votes", "net_votes"])
    return filled.withColumns({"sc_trend": ranking.trending(F.col("rshares"), F.col("created")), "sc_hot": ranking.hot(F.col("rshares"), F.col("created"))})

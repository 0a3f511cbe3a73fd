"""Jobs that keep derived columns: sequence numbers, first occurrences, waves, deltas of counts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.functions import text
from agorafold.operators import threads
from agorafold.sources import sinks, tables

RETENTION_DAYS = 90


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with consecutive numbers in an order, without a window over all of them.

    Rows are dealt to tasks by ranges of the order and numbered inside; each
    task's rows start where those of the tasks before end.
    """
    shared = sinks.Shared(rows.sparkSession, "numbered")
    placed = shared.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()))
    place, inside = F.shiftright("__n", 33), F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(place.alias("__p")).agg(F.count("*").alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))  # a row a task
    return placed.join(F.broadcast(before), place == F.col("__p")).withColumn(name, F.col("__b") + inside + first).drop("__n", "__p", "__b")


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts numbered in the order of time and id."""
    return numbered(tables.posts(spark, sf_dir).select("id", "created"), ["created", "id"], "number").select("id", "number")


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with whether they are their author's first one in a category."""
    at = F.row_number().over(Window.partitionBy("author", "category").orderBy("created", "id"))
    return tables.live_posts(spark, sf_dir).select("id", (at == 1).alias("is_first"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wave, n): posts by the wave in which they can be resolved, the parent's being the one before; the last is the deepest level."""
    found = threads.depths(tables.posts(spark, sf_dir).select("id", "parent"))
    return found.groupBy(F.col("depth").cast("int").alias("wave")).agg(F.count("*").alias("n"))


def child_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of new posts (the last tenth by id) adds to the counts of all that are above them."""
    posts = tables.links(spark, sf_dir).select("id", "parent")
    head = posts.agg((F.max("id") * 9 / 10).alias("from"))
    new = posts.crossJoin(F.broadcast(head)).where(F.col("id") > F.col("from")).select("id")  # one row
    return threads.gained(posts, new).select("id", F.col("n").alias("delta"))


def retained(rows: DataFrame, at: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last days before the newest one."""
    head = rows.agg(F.max(at).alias("__head"))
    return rows.crossJoin(F.broadcast(head)).where(F.col(at) > F.col("__head") - F.make_interval(days=F.lit(days))).drop("__head")  # one row


def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(tables.read(spark, sf_dir, "events"), "ts", 10).groupBy("event_type").agg(F.count("*").alias("n"))


def next_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post with the creation of the one numbered next: a join on id + 1, not a window over all."""
    posts = tables.posts(spark, sf_dir).select("id", "created")
    after = posts.select((F.col("id") - 1).alias("before"), F.col("created").alias("next_created"))
    return posts.join(after, F.col("id") == F.col("before"), "left").select("id", "next_created")


def post_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, mention): known accounts that a post's body mentions, but its author. Bodies and names are made from the keys."""
    posts = tables.live_posts(spark, sf_dir).select("id", "author")
    piece = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    body = piece("Thanks @C", F.col("author"), ", @c", F.col("author") % 97 + 1, " and @nobody", F.col("author") % 5, "; mail me@c1.com. (@c", F.col("id") % 13 + 1, ")")
    found = posts.select("id", piece("c", F.col("author")).alias("self"), F.explode(text.mentions(body)).alias("mention"))
    known = tables.read(spark, sf_dir, "customer").select(piece("c", F.col("c_custkey")).alias("name"))
    return found.where("mention <> self").join(known, F.col("mention") == F.col("name"), "left_semi").select("id", "mention")

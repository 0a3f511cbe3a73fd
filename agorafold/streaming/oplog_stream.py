"""The log as a stream: each micro-batch is folded into versioned state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agorafold.operators import folds, sums
from agorafold.sources import oplog, sinks

FOLDS = {
    "accounts": (folds.fold_accounts, folds.ACCOUNTS),
    "votes": (folds.fold_votes, folds.VOTES),
    "posts": (folds.fold_posts, folds.POSTS),
    "edges": (folds.fold_follows, folds.EDGES),
    "reblogs": (folds.fold_reblogs, folds.REBLOGS),
    "payouts": (folds.fold_payouts, folds.PAYOUTS),
    "options": (folds.fold_options, folds.OPTIONS),
    "communities": (folds.fold_communities, folds.COMMUNITIES),
    "last_reads": (folds.fold_last_reads, folds.LAST_READS),
}


def _posts(log: DataFrame) -> DataFrame:
    return log.where(F.col("op_type") != oplog.TYPES["custom_json"]).select(oplog.field("author").alias("author"), oplog.field("permlink").alias("permlink"))


def _reblogged(log: DataFrame) -> DataFrame:
    """Posts that are shared, or that go and take their reblogs along."""
    shared = oplog.custom(log).where(F.col("kind").isin("reblog", "follow") & (F.col("action") == "reblog"))
    shared = shared.select(F.get_json_object("data", "$.author").alias("author"), F.get_json_object("data", "$.permlink").alias("permlink"))
    return shared.unionByName(folds.deletions(log).select("author", "permlink"))


def _names(log: DataFrame) -> DataFrame:
    fields = [oplog.field(n) for n in ("new_account_name", "worker_account", "account")]
    return log.where(F.col("op_type") != oplog.TYPES["custom_json"]).select(F.explode(F.array(*fields)).alias("name"))


def _signers(log: DataFrame) -> DataFrame:
    return oplog.custom(log).select("account")


def _communities(log: DataFrame) -> DataFrame:
    return oplog.custom(log).where("kind = 'community'").select(F.get_json_object("data", "$.community").alias("community"))


#: What a state table is divided by, and all values of it that a log's operations can change.
KEYS = {
    "accounts": (["name"], _names),
    "votes": (["author", "permlink"], _posts),
    "posts": (["author", "permlink"], _posts),
    "edges": (["follower"], _signers),
    "reblogs": (["author", "permlink"], _reblogged),
    "payouts": (["author", "permlink"], _posts),
    "options": (["author", "permlink"], _posts),
    "communities": (["community"], _communities),
    "last_reads": (["account"], _signers),
}


#: Tables made from the states of posts and reblogs, divided like them: a batch makes the buckets anew in which either changes, so what a deleted post leaves behind goes with it.
DERIVED = {"tags": (folds.post_tags, folds.TAGS), "feed": (folds.feed_entries, folds.FEED)}


#: Sums kept from the changes of a state: its name, the changes, the group, the count and the table's columns.
SUMS = {
    "vote_sums": ("votes", sums.vote_deltas, ["author", "permlink"], "votes", sums.VOTE_SUMS),
    "follow_sums": ("edges", sums.follow_deltas, ["account", "side"], "n", sums.FOLLOW_SUMS),
}


def _touched(log: DataFrame) -> dict:
    """The buckets that a log can change, by how its keys are read; at most ``sinks.BUCKETS`` numbers each."""
    touched = {}
    for read in {read for _, read in KEYS.values()}:
        keys = read(log)
        touched[read] = {r["b"] for r in keys.select(sinks.bucket(*keys.columns).alias("b")).distinct().collect()}
    return touched


def fold_batch(spark: SparkSession, log: DataFrame, root: str, version: int) -> None:
    """Fold one batch into the state of the version before and write the next.

    Only buckets with a key that the batch names are read and written; the
    others stay where their last version is.  A batch that is run again reads
    the same state and replaces the same version.  The batch's source is read
    once; the folds read what was kept.
    """
    shared = sinks.Shared(spark, "batch")
    log = shared.keep(log)
    touched = _touched(log)
    for name, (fold, schema) in FOLDS.items():
        keys, read = KEYS[name]
        state = sinks.read_snapshot(spark, root, name, version - 1, schema, touched[read])
        sinks.write_snapshot(fold(state, log), keys, root, name, version)
        sinks.drop_replaced(spark, root, name, version)
    for name, (of, changes, group, count, schema) in SUMS.items():
        only = touched[KEYS[of][1]]
        before, after = (sinks.read_snapshot(spark, root, of, v, FOLDS[of][1], only) for v in (version - 1, version))
        found = shared.keep(changes(before, after))
        buckets = {r["b"] for r in found.select(sinks.bucket(*group).alias("b")).distinct().collect()}
        kept = sinks.read_snapshot(spark, root, name, version - 1, schema, buckets)
        sinks.write_snapshot(sums.merged(kept, found, group, count), group, root, name, version, emptied=buckets)
        sinks.drop_replaced(spark, root, name, version)
        shared.drop(found)
    changed = touched[_posts] | touched[_reblogged]
    posts, reblogs = (sinks.read_snapshot(spark, root, name, version, FOLDS[name][1], changed) for name in ("posts", "reblogs"))
    for name, (make, _) in DERIVED.items():
        sinks.write_snapshot(make(posts, reblogs), ["author", "permlink"], root, name, version, emptied=changed)
        sinks.drop_replaced(spark, root, name, version)
    shared.drop(log)


def start(spark: SparkSession, source: str, root: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Fold all log files in ``source`` that are there now, ``files`` a batch, then stop.

    A block's operations must be in one file.
    """
    reader = spark.readStream.schema(oplog.SCHEMA)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    writer = reader.parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: fold_batch(batch.sparkSession, batch, root, number)).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream by window and type; an extension of our own."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

"""Notifications of a batch of operations, types 11 to 17, and the table that keeps them.

Each type is a function of the batch and of the fold states that it needs; it
gives candidates with a counter within their block.  ``told`` leaves out those
that their addressee doesn't hear of (its own doing, senders of low reputation,
senders muted by it or by lists that it follows, blocks before the bound) and
gives the others their score and id.  ``add`` puts them into the table: a
notification is known by source, addressee, type, post and block, and blocks up
to the last one added are skipped, so a repeated batch changes nothing.

Times are those of the block before, as operations are stamped.  Places within
a block go by natural keys where a database would number rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.functions import ids, ranking, reputation, rules, text
from agorafold.operators import folds
from agorafold.sources import fixture_log, oplog, sinks, tables

#: A row of type ``MARK`` says up to which block the table has been filled.
NOTICES = "id long, type_id int, block_num int, created timestamp_ntz, src string, dst string, author string, permlink string, score int, payload string, community string"
KEY = ["src", "dst", "type_id", "author", "permlink", "block_num"]
MARK = 0
SUBSCRIBE, REPLY, REPLY_COMMENT, REBLOG, FOLLOW, MENTION, VOTE = range(11, 18)
# Days for which notifications are kept, and for which votes on a post are told; blocks between prunings.
KEPT_DAYS, POST_DAYS, PRUNE_EVERY = 90, 97, 1200
_CANDIDATE = ["type_id", "block_num", "created", "counter", "src", "dst", "author", "permlink", "payload", "community"]


@dataclass(frozen=True)
class Bounds:
    """Operations of blocks after ``block`` are told; votes on posts last changed after ``post_block``."""

    block: int
    post_block: int


def bounds(irreversible: int, head: int, block_seconds: int = ids.BLOCK_SECONDS) -> Bounds:
    return Bounds(irreversible - KEPT_DAYS * 86400 // block_seconds, head - POST_DAYS * 86400 // block_seconds)


def _counted(rows: DataFrame, *order: str, step: int = 1) -> DataFrame:
    """With a counter within each block."""
    return rows.withColumn("counter", (F.row_number().over(Window.partitionBy("block_num").orderBy(*order)) * step).cast("int"))


def _candidates(rows: DataFrame, kind: Column | int, **more: Column) -> DataFrame:
    given = {"author": F.lit(""), "permlink": F.lit(""), "payload": F.lit(""), "community": F.lit("")} | more
    rows = rows.withColumns({"type_id": F.lit(kind) if isinstance(kind, int) else kind, **{k: v for k, v in given.items() if k in more or k not in rows.columns}})
    return rows.select(*_CANDIDATE)


def _stamped(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """With ``created``, the time of the block before. blocks: as ``oplog.blocks`` gives them."""
    times = blocks.select(F.col("block_num").alias("__b"), F.col("previous_ts").alias("created"))
    return rows.join(times, F.col("block_num") == F.col("__b")).drop("__b")


def subscribes(log: DataFrame, before: DataFrame, blocks: DataFrame) -> DataFrame:
    """Communities hear of new subscribers. before: communities' state before the batch."""
    ops = oplog.custom(log).where((F.col("kind") == "community") & F.col("action").isin("subscribe", "unsubscribe"))
    rows = ops.select("op_id", "block_num", F.col("account").alias("src"), F.get_json_object("data", "$.community").alias("dst"), (F.col("action") == "subscribe").alias("joins")).where(text.is_community(F.col("dst")))
    known = before.where("kind = 'subscriber' and value is not null").select(F.col("community").alias("__c"), F.col("key").alias("__k"))
    had = F.coalesce(F.lag("joins").over(Window.partitionBy("dst", "src").orderBy("op_id")), F.col("__c").isNotNull())
    rows = rows.join(known, (F.col("dst") == F.col("__c")) & (F.col("src") == F.col("__k")), "left").withColumn("had", had).where("joins and not had")
    return _candidates(_stamped(_counted(rows, "op_id"), blocks), SUBSCRIBE, community=F.col("dst"))


def replies(before: DataFrame, posts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Authors hear of replies to their posts and comments. before, posts: posts' state before and after the batch."""
    keys = ["author", "permlink", "generation"]
    new = posts.where("parent_author <> ''").join(before.select(*keys), keys, "left_anti")
    new = _counted(new.withColumn("block_num", F.col("created_block")).drop("created"), *keys)
    above = posts.groupBy(F.col("author").alias("__a"), F.col("permlink").alias("__p")).agg(F.max_by(F.col("parent_author") == "", "generation").alias("to_root"))
    joined = new.join(above, (F.col("parent_author") == F.col("__a")) & (F.col("parent_permlink") == F.col("__p")))
    rows = joined.select("block_num", "counter", F.col("author").alias("src"), F.col("parent_author").alias("dst"), "author", "permlink", "to_root")
    return _candidates(_stamped(rows, blocks), F.when(F.col("to_root"), REPLY).otherwise(REPLY_COMMENT), author=F.col("author"), permlink=F.col("permlink"))


def reblogs(state: DataFrame, first: int, last: int, posts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Authors hear who shares their posts. state: reblogs after the batch, whose blocks are first to last."""
    known = posts.select("author", "permlink").distinct()
    new = state.where(F.col("block_num").between(first, last) & ~F.col("deleted")).join(known, ["author", "permlink"], "left_semi")
    rows = _counted(new, "account", "author", "permlink").select("block_num", "created", "counter", F.col("account").alias("src"), F.col("author").alias("dst"), "author", "permlink")
    return _candidates(rows, REBLOG, author=F.col("author"), permlink=F.col("permlink"))


def follows(log: DataFrame, accounts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Accounts hear of every act of following, those that come again too."""
    rows = folds.follow_documents(log).where(F.col("what").isin("blog", "follow")).select("op_id", "block_num", F.col("follower").alias("src"), F.explode("names").alias("dst"))
    for side in ("src", "dst"):
        rows = rows.join(accounts.select(F.col("name").alias(side)), side, "left_semi")
    return _candidates(_stamped(_counted(rows, "op_id", "dst"), blocks), FOLLOW)


def mentions(posts: DataFrame, first: int, last: int, accounts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Accounts hear where they are mentioned, in live posts that the batch made or changed."""
    changed = posts.where(F.col("block_num").between(first, last) & ~F.col("deleted"))
    rows = changed.select("block_num", "author", "permlink", F.col("author").alias("src"), F.explode(text.mentions(F.col("body"))).alias("dst")).where("src <> dst")
    rows = rows.join(accounts.select(F.col("name").alias("dst")), "dst", "left_semi")
    return _candidates(_stamped(_counted(rows, "author", "permlink", "dst"), blocks), MENTION, author=F.col("author"), permlink=F.col("permlink"))


def votes(state: DataFrame, first: int, last: int, posts: DataFrame, payouts: DataFrame, edges: DataFrame, told_from: Bounds) -> DataFrame:
    """Authors hear of weighty votes; each vote takes two places of a block's count. state, payouts: after the batch."""
    keys = ["author", "permlink"]
    live = posts.where(~F.col("deleted") & (F.col("block_num") > told_from.post_block)).select(*keys)
    on_live = state.join(live, keys, "left_semi")
    sums = on_live.groupBy(*keys).agg(F.sum("rshares").alias("sum_rshares"), F.sum(F.abs("rshares")).alias("abs_rshares"))
    worth = payouts.select(*keys, (F.col("payout") + F.col("pending")).alias("worth"))
    new = on_live.where(F.col("block_num").between(max(first, told_from.block + 1), last)).select(*keys, F.col("voter").alias("src"), F.col("author").alias("dst"), "rshares", "block_num", F.col("last_update").alias("created"))
    heard = _counted(not_muted(new, edges), "src", *keys, step=2)
    joined = heard.join(sums, keys).join(worth, keys, "left").withColumn("worth", F.coalesce("worth", F.lit(0).cast("decimal(20,3)")))
    value = ranking.vote_value(F.col("worth"), F.col("sum_rshares"), F.col("rshares"))
    scored = joined.withColumns({"value": value, "score": ranking.vote_score(F.col("worth"), F.col("abs_rshares"), F.col("rshares"))})
    scored = scored.where(rules.vote_is_told(F.col("src"), F.col("dst"), F.col("score"), F.col("rshares"), F.col("value"), F.lit(False)))
    rows = scored.withColumns({"type_id": F.lit(VOTE), "payload": ranking.vote_payload(F.col("value")), "community": F.lit("")})
    return rows.select(*_CANDIDATE, F.col("score").cast("int").alias("score"))


def not_muted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (src, dst) without those whose addressee mutes the source, or follows the mute list of one who does.

    Only lists that the addressees of these rows follow are looked at, one
    list at a time against the list's mutes.
    """
    kinds = lambda kind, a, b: edges.where(F.col("kind") == kind).select(F.col("follower").alias(a), F.col("following").alias(b))
    direct = kinds("mute", "dst", "src")
    lists, listed = kinds("follow_mute", "dst", "__list"), kinds("mute", "__list", "src")
    pairs = rows.select("src", "dst").distinct().join(lists, "dst").join(listed, ["__list", "src"], "left_semi").select("dst", "src")
    return rows.join(direct.unionByName(pairs).distinct(), ["dst", "src"], "left_anti")


def told(candidates: DataFrame, edges: DataFrame, reputations: DataFrame, told_from: Bounds) -> DataFrame:
    """Notifications of candidates. reputations: (name, reputation); those who have none count as 0."""
    rows = candidates.where((F.col("block_num") > told_from.block) & (F.col("src") != F.col("dst")))
    if "score" not in rows.columns:
        known = reputations.select(F.col("name").alias("src"), "reputation")
        rows = not_muted(rows, edges).join(known, "src", "left").withColumn("score", reputation.notification_score(F.col("reputation"))).where("score > 0")
    return rows.select(ids.pack(F.col("created"), F.col("type_id"), F.col("counter")).alias("id"), "type_id", "block_num", "created", "src", "dst", "author", "permlink", F.col("score").cast("int").alias("score"), "payload", "community")


def add(table: DataFrame, new: DataFrame, last: int, mentioning: DataFrame | None = None) -> DataFrame:
    """The table after a batch that ends with block ``last``.

    mentioning: (author, permlink) of posts that the batch changed; what they
    mentioned before and no longer do goes.
    """
    spark = table.sparkSession
    done = table.where(F.col("type_id") == MARK).agg(F.coalesce(F.max("block_num"), F.lit(-1)).alias("__done"))  # one row
    fresh = new.crossJoin(F.broadcast(done)).where(F.col("block_num") > F.col("__done")).drop("__done")
    kept = table.where(F.col("type_id") != MARK)
    if mentioning is not None:
        still = new.where(F.col("type_id") == MENTION).select("author", "permlink", "dst", F.lit(True).alias("__still"))
        changed = mentioning.select("author", "permlink", F.lit(True).alias("__changed")).distinct()
        marked = kept.join(changed, ["author", "permlink"], "left").join(still.distinct(), ["author", "permlink", "dst"], "left")
        kept = marked.where(~((F.col("type_id") == MENTION) & F.col("__changed").isNotNull() & F.col("__still").isNull())).select(*table.columns)
    merged = kept.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1))).groupBy(*KEY).agg(F.min(F.struct("__new", *[c for c in table.columns if c not in KEY])).alias("r"))
    rows = merged.select(*[F.col(c) if c in KEY else F.col(f"r.{c}").alias(c) for c in table.columns])
    mark = done.select(F.greatest(F.col("__done"), F.lit(last)).alias("block_num"))
    empty = spark.createDataFrame([], NOTICES)
    marked = mark.select(*[F.lit(0).cast("long").alias("id"), F.lit(MARK).alias("type_id"), "block_num", *[F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in table.columns if c not in ("id", "type_id", "block_num")]])
    return rows.unionByName(marked)


def prune(table: DataFrame, head: int, every: int = PRUNE_EVERY, block_seconds: int = ids.BLOCK_SECONDS) -> DataFrame:
    """Once an hour, without the notifications that are past their days."""
    if head % every:
        return table
    return table.where((F.col("type_id") == MARK) | (F.col("block_num") > head - KEPT_DAYS * 86400 // block_seconds))


# Queries over logs made from the given tables: their blocks are days.
DAY = 86400
HEADS = {SUBSCRIBE: 60, FOLLOW: 120}
HEAD = 2300


def _setting(spark: SparkSession, sf_dir: str, kind: int):
    """(head block, bounds, blocks, edges, reputations) of a query."""
    head = fixture_log.FIRST + HEADS.get(kind, HEAD)
    blocks = spark.range(fixture_log.FIRST, head + 1).select(F.col("id").cast("int").alias("block_num"), (F.lit(fixture_log.EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") - fixture_log.FIRST - 1).cast("int"))).alias("previous_ts"))
    edges = folds.fold_follows(sinks.nothing(spark, folds.EDGES), fixture_log.mute_lists(spark, sf_dir))
    return head, bounds(head, head, DAY), blocks, edges, fixture_log.reputations(spark, sf_dir)


def _query(kind: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        head, told_from, blocks, edges, known = _setting(spark, sf_dir, kind)
        shared = sinks.Shared(spark, "notices")
        state = lambda name, fold, schema, log: shared.keep(fold(sinks.nothing(spark, schema), oplog.scan(log(spark, sf_dir), None, head)))
        empty = lambda schema: sinks.nothing(spark, schema)
        first = fixture_log.FIRST
        if kind == SUBSCRIBE:
            found = subscribes(oplog.scan(fixture_log.communities(spark, sf_dir), None, head), empty(folds.COMMUNITIES), blocks)
        elif kind == FOLLOW:
            found = follows(oplog.scan(fixture_log.follows(spark, sf_dir), None, head), known, blocks)
        else:
            posts = state("posts", folds.fold_posts, folds.POSTS, fixture_log.threads)
            if kind == REPLY:
                found = replies(empty(folds.POSTS), posts, blocks)
            elif kind == REBLOG:
                found = reblogs(state("reblogs", folds.fold_reblogs, folds.REBLOGS, fixture_log.thread_reblogs), first, head, posts, blocks)
            elif kind == MENTION:
                found = mentions(posts, first, head, known, blocks)
            else:
                cast, paid = state("votes", folds.fold_votes, folds.VOTES, fixture_log.thread_votes), state("payouts", folds.fold_payouts, folds.PAYOUTS, fixture_log.payouts)
                found = votes(cast, first, head, posts, paid, edges, told_from)
        new = shared.keep(told(found, edges, known, told_from))
        once = shared.keep(add(empty(NOTICES), new, head))
        return add(once, new, head).where(F.col("type_id") != MARK).drop("community")

    return run


notices_subscribe, notices_reply, notices_reblog, notices_follow, notices_mention, notices_vote = (_query(k) for k in (SUBSCRIBE, REPLY, REBLOG, FOLLOW, MENTION, VOTE))

"""Notifications: identifiers, messages, unread counts, event order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.functions import bitmask, ids, ranking
from agorafold.sources import tables

# Notification types by number with their message.
MESSAGES = {
    1: ("new_community", "<dst> was created"),
    2: ("set_role", "<src> set your role to <payload>"),
    3: ("set_props", "<src> set properties <payload>"),
    4: ("set_title", "<src> set your title to <payload>"),
    5: ("mute_post", "<src> muted your post - <payload>"),
    6: ("unmute_post", "<src> unmuted your post - <payload>"),
    7: ("pin_post", "<src> pinned your post"),
    8: ("unpin_post", "<src> unpinned your post"),
    9: ("flag_post", "<src> flagged a post - <payload>"),
    10: ("error", "error: <payload>"),
    11: ("subscribe", "<src> subscribed to <comm>"),
    12: ("reply", "<src> replied to your post"),
    13: ("reply_comment", "<src> replied to your comment"),
    14: ("reblog", "<src> reblogged your post"),
    15: ("follow", "<src> followed you"),
    16: ("mention", "<src> mentioned you and <other_mentions> others"),
    17: ("vote", "<src> voted on your post"),
}
EVENT_TYPES = {"click": 17, "error": 10, "purchase": 14, "signup": 15, "view": 12}


def message(kind: Column, src: Column, dst: Column, payload: Column, community: Column, mentions: Column) -> Column:
    """The text of a notification; absent parts are empty, an absent payload is ``null``."""
    text = F.lit(None).cast("string")
    for number, (_, template) in MESSAGES.items():
        text = F.when(kind == number, template).otherwise(text)
    text = F.when((kind == 17) & (F.coalesce(payload, F.lit("")) != ""), F.concat(text, F.lit(" <payload>"))).otherwise(text)
    filled = {
        "<dst>": F.concat(F.lit("@"), F.coalesce(dst, F.lit(""))), "<src>": F.concat(F.lit("@"), F.coalesce(src, F.lit(""))), "<payload>": F.coalesce(payload, F.lit("null")),
        "<comm>": F.coalesce(community, F.lit("")), "<other_mentions>": (F.coalesce(mentions, F.lit(1)) - 1).cast("string"),
    }
    for mark, value in filled.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def _kind() -> Column:
    out = F.lit(0)
    for name, number in EVENT_TYPES.items():
        out = F.when(F.col("event_type") == name, number).otherwise(out)
    return out


def notification_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notifications: packed identifiers and what they unpack to."""
    counter = F.row_number().over(Window.partitionBy(F.date_trunc("hour", F.col("ts").cast("timestamp"))).orderBy("event_id"))
    events = tables.read(spark, sf_dir, "events").withColumn("counter", counter).withColumn("kind", _kind())
    packed = events.select("event_id", ids.pack(F.col("ts"), F.col("kind"), F.col("counter")).alias("id"))
    back = packed.withColumn("u", ids.unpack(F.col("id")))
    return back.select("event_id", "id", F.col("u.created").alias("created"), F.col("u.kind").alias("kind"), F.col("u.counter").alias("counter"))


def notification_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read(spark, sf_dir, "events").withColumn("kind", _kind())
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    payload = F.when(F.col("kind").isin(10, 17), F.get_json_object("props", "$.k"))
    return events.select("event_id", "kind", message(F.col("kind"), name, F.lit(None), payload, F.lit(None), F.lit(None)).alias("msg"))


def account_notifications(spark: SparkSession, sf_dir: str, account: int = 7, min_score: int = 25, last: int | None = None, limit: int = 50) -> DataFrame:
    """The newest notifications of one user with a least score, from before one of them."""
    events = tables.read(spark, sf_dir, "events").where(F.col("user_id") == account)
    events = (events if last is None else events.where(F.col("event_id") < last)).withColumn("kind", _kind())
    scored = events.withColumn("score", F.least(F.lit(100), F.floor(F.col("value")).cast("int")))
    return scored.where(F.col("score") >= min_score).orderBy(F.col("event_id").desc()).limit(limit).select("event_id", "kind", "score", "ts")


def post_notifications(spark: SparkSession, sf_dir: str, post: int = 1, limit: int = 50) -> DataFrame:
    """What a post's author is told of it: replies (12 to a root post, else 13), then votes of a score (17)."""
    posts = tables.live_posts(spark, sf_dir)
    one = posts.where(F.col("id") == post).select("payout", F.col("parent").isNull().alias("is_root"))
    replies = posts.where(F.col("parent") == post).crossJoin(F.broadcast(one.select("is_root")))  # one row
    replies = replies.select(F.when(F.col("is_root"), 12).otherwise(13).alias("kind"), F.col("author").alias("src"), F.lit(100).alias("score"))
    own = tables.votes(spark, sf_dir).where(F.col("post") == post)
    sums = own.agg(F.sum(F.abs("rshares")).alias("abs_rshares")).crossJoin(one.select("payout"))  # one row
    each = own.groupBy("voter").agg(F.sum("rshares").alias("rshares")).crossJoin(F.broadcast(sums))
    votes = each.select(F.lit(17).alias("kind"), F.col("voter").alias("src"), ranking.vote_score(F.col("payout"), F.col("abs_rshares"), F.col("rshares")).alias("score")).where("score >= 0")
    return replies.unionByName(votes).orderBy("kind", F.col("score").desc(), F.col("src").desc()).limit(limit)


def unread_asof(spark: SparkSession, sf_dir: str, read_until: str = "2024-01-15 00:00:00") -> DataFrame:
    """Per user the last event read (the latest up to a time) and how many came after it."""
    read_until = F.lit(read_until).cast("timestamp_ntz")
    seen = F.when(F.col("ts") <= read_until, F.col("event_id"))
    return tables.read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by(seen, F.when(F.col("ts") <= read_until, F.struct("ts", "event_id"))).alias("last_read"), F.count_if(F.col("ts") > read_until).alias("unread")
    )


def block_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the time of its user's previous one, the first with its own."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return tables.read(spark, sf_dir, "events").select("event_id", "ts", F.coalesce(before, F.col("ts")).alias("previous"))


def op_history(spark: SparkSession, sf_dir: str, page: int = 3, size: int = 10, account: int | None = None) -> DataFrame:
    """A page of every user's events (or one user's), newest first."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))
    return tables.read(spark, sf_dir, "events").withColumn("at", at).where(F.col("at").between((page - 1) * size + 1, page * size) & (F.lit(account is None) | (F.col("user_id") == (account or 0)))).select("user_id", "at", "event_id", "event_type")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload documents parsed, filtered and grouped; bad documents are left out."""
    events = tables.read(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").try_cast("int")
    rows = events.select("event_type", key.alias("k"), "value").where(F.col("k").isNotNull() & (F.col("event_type") != "error"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))


def muted_reason_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reasons for muting: encoded, decoded and named; rows without reasons are left out."""
    reasons = F.array_compact(F.array(F.when(F.col("toxic") == 1, 0), F.when(F.col("quality") == 0, 2)))
    rows = tables.read(spark, sf_dir, "labels").select("doc_id", bitmask.encode(reasons).alias("mask")).where("mask <> 0")
    return rows.select("doc_id", "mask", F.array_join(bitmask.names(F.col("mask")), ",").alias("reasons"))

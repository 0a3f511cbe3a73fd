"""Folds of the operation log into state tables: pure functions (state, operations) -> state.

Each fold is a join and an aggregation by key, so a batch of any size is
spread by key; only the changes of a community's roles are read in order.  Every state row carries the last block that changed it, and
operations up to that block are skipped for it: a repeated batch, of any age,
changes nothing, and a log cut at block boundaries gives the same state as the
whole.  What is deleted stays as a row that says so, with its block, so that an
older batch can't bring it back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorafold.functions import patch, rules, text
from agorafold.sources import oplog

ACCOUNTS = "name string, created timestamp_ntz, posting_metadata string, json_metadata string, block_num int"
VOTES = "voter string, author string, permlink string, weight decimal(38,0), rshares bigint, percent int, last_update timestamp_ntz, num_changes int, is_effective boolean, block_num int"
POSTS = "author string, permlink string, generation int, parent_author string, parent_permlink string, title string, body string, tags array<string>, created timestamp_ntz, updated timestamp_ntz, deleted boolean, block_num int, created_block int"
#: grp: the group of actions that exclude each other; kind is null for an edge that is gone.
EDGES = "follower string, following string, grp string, kind string, block_num int, op_id long"
REBLOGS = "account string, author string, permlink string, created timestamp_ntz, deleted boolean, block_num int"
OPTIONS = "author string, permlink string, max_payout string, percent int, allow_votes boolean, allow_curation boolean, beneficiaries string, block_num int"
TAGS = "author string, permlink string, tag string"
FEED = "account string, author string, permlink string, created timestamp_ntz"
LAST_READS = "account string, read_at timestamp_ntz, block_num int"
PAYOUTS = "author string, permlink string, payout decimal(20,3), pending decimal(20,3), is_paid boolean, last_payout timestamp_ntz, block_num int"
CREATES = ("account_create", "account_create_delegated", "create_claimed_account", "pow", "pow2")


def _newer(ops: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Operations of blocks after the last that changed their key's state row."""
    seen = state.groupBy(*keys).agg(F.max("block_num").alias("__seen"))
    return ops.join(seen, keys, "left").where(F.col("__seen").isNull() | (F.col("block_num") > F.col("__seen"))).drop("__seen")


def _last(value, order="op_id"):
    """The last value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def fold_accounts(state: DataFrame, log: DataFrame) -> DataFrame:
    """The first creation makes an account; the last non-empty metadata of each kind wins."""
    ops = oplog.scan(log, types=(*CREATES, "account_update", "account_update2"))
    creates = F.col("op_type").isin(*[oplog.TYPES[t] for t in CREATES])
    filled = lambda name: F.nullif(oplog.field(name), F.lit(""))
    rows = ops.select(
        F.when(creates, F.coalesce(oplog.field("new_account_name"), oplog.field("worker_account"))).otherwise(oplog.field("account")).alias("name"),
        "op_id", "block_num", F.when(creates, F.col("block_ts")).alias("created"), filled("posting_json_metadata").alias("posting"), filled("json_metadata").alias("meta"),
    ).where("name is not null")
    changes = _newer(rows, state, ["name"]).groupBy("name").agg(F.min_by("created", F.when(F.col("created").isNotNull(), F.col("op_id"))).alias("c"), _last(F.col("posting")).alias("p"), _last(F.col("meta")).alias("m"), F.max("block_num").alias("b"))
    return state.join(changes, "name", "full").select(
        "name", F.coalesce("created", "c").alias("created"), F.coalesce("p", "posting_metadata").alias("posting_metadata"), F.coalesce("m", "json_metadata").alias("json_metadata"), F.greatest("block_num", "b").alias("block_num"),
    ).where("created is not null")


def fold_votes(state: DataFrame, log: DataFrame) -> DataFrame:
    """The last plain vote gives percent and time, the last effective one weight and rshares; changes are counted."""
    keys = ["voter", "author", "permlink"]
    ops = oplog.scan(log, types=("vote", "effective_vote"))
    plain = F.col("op_type") == oplog.TYPES["vote"]
    rows = oplog.fields(ops, ["op_id", "block_num", "block_ts", "op_type"], *keys, "weight", "total_vote_weight", "rshares").select(
        *keys, "op_id", "block_num", F.when(plain, F.col("weight").cast("int")).alias("p"), F.when(plain, F.col("block_ts")).alias("t"),
        F.when(~plain, F.col("total_vote_weight").cast("decimal(38,0)")).alias("w"), F.when(~plain, rules.rshares(F.col("block_num"), F.col("rshares").cast("bigint"))).alias("r"),
    )
    changes = _newer(rows, state, keys).groupBy(*keys).agg(_last(F.col("p")).alias("p"), _last(F.col("t")).alias("t"), _last(F.col("w")).alias("w"), _last(F.col("r")).alias("r"), F.count("t").alias("n"), F.max("block_num").alias("b"))
    first = F.col("block_num").isNull()
    return state.join(changes, keys, "full").select(
        *keys, F.coalesce("w", "weight").cast("decimal(38,0)").alias("weight"), F.coalesce("r", "rshares", F.lit(0).cast("long")).alias("rshares"), F.coalesce("p", "percent", F.lit(0)).alias("percent"), F.coalesce("t", "last_update").alias("last_update"),
        F.when(first, F.greatest(F.col("n") - 1, F.lit(0))).otherwise(F.col("num_changes") + F.coalesce("n", F.lit(0))).cast("int").alias("num_changes"),
        (F.coalesce("is_effective", F.lit(False)) | F.col("r").isNotNull()).alias("is_effective"), F.greatest("block_num", "b").alias("block_num"),
    )


def fold_posts(state: DataFrame, log: DataFrame) -> DataFrame:
    """Posts by (author, permlink, generation): a comment after a deletion starts the next generation.

    Deletions that had no effect are told by an operation of their own and
    skipped.  An edit keeps the parent and replaces title and tags, and the
    body, which it may give as a patch of the one before.
    """
    keys = ["author", "permlink"]
    ops = oplog.scan(log, types=("comment", "delete_comment", "ineffective_delete"))
    written = ["parent_author", "parent_permlink", "title", "body", "json_metadata"]
    rows = _newer(oplog.fields(ops, ["op_id", "block_num", "block_ts", "op_type"], *keys, *written), state, keys)
    spared = rows.where(F.col("op_type") == oplog.TYPES["ineffective_delete"]).select(*keys, "block_num").distinct()
    deletes = rows.where(F.col("op_type") == oplog.TYPES["delete_comment"]).join(spared, [*keys, "block_num"], "left_anti")
    comments = rows.where(F.col("op_type") == oplog.TYPES["comment"])
    last = state.groupBy(*keys).agg(F.max("generation").alias("g0"), F.max_by("deleted", "generation").alias("d0"))
    # Of metadata only the tags move, and they are read once a post.
    tagged = comments.withColumns({"json_metadata": F.coalesce(F.get_json_object("json_metadata", "$.tags"), F.lit("[]")), "gone": F.lit(0)})
    events = tagged.unionByName(deletes.select(*comments.columns).withColumn("gone", F.lit(1))).withColumnRenamed("json_metadata", "raw_tags")
    in_order = Window.partitionBy(*keys).orderBy("op_id")
    step = F.coalesce(F.sum("gone").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    patches = F.coalesce(F.max(F.col("body").startswith("@@ ") & (F.col("gone") == 0)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False))
    placed = events.join(last, keys, "left").withColumn("any_patch", patches).withColumn("generation", (F.coalesce("g0", F.lit(0)) + step + F.when((F.coalesce("d0", F.lit(False))) & (F.col("gone") == 0), 1).otherwise(0)).cast("int"))
    is_comment = F.col("gone") == 0
    value = lambda name: F.when(is_comment, F.col(name))
    read = placed.select(*keys, "generation", "op_id", "block_num", "block_ts", "gone", value("parent_author").alias("pa"), value("parent_permlink").alias("pp"), value("title").alias("ti"), value("body").alias("bo"), value("raw_tags").alias("ta"), F.col("any_patch"))
    # Bodies are gathered only of posts that have a patch; the window has the order of the aggregation below.
    edit = F.when(F.col("any_patch") & F.col("bo").isNotNull(), F.struct("op_id", "bo"))
    read = read.withColumn("edits", F.collect_list(edit).over(Window.partitionBy(*keys, "generation")))
    first = lambda c: F.min_by(c, F.when(F.col("gone") == 0, F.col("op_id")))
    changes = read.groupBy(*keys, "generation").agg(
        first("pa").alias("pa"), first("pp").alias("pp"), _last(F.col("ti")).alias("ti"), _last(F.col("bo")).alias("bo"), F.max(F.col("bo").startswith("@@ ")).alias("patched"),
        F.transform(F.array_sort(F.first("edits")), lambda e: e["bo"]).alias("edits"), _last(F.col("ta")).alias("ta"),
        F.min(F.when(F.col("gone") == 0, F.col("block_ts"))).alias("c"), F.max("block_ts").alias("u"), (F.max("gone") == 1).alias("d"), F.max("block_num").alias("b"), F.min(F.when(F.col("gone") == 0, F.col("block_num"))).alias("cb"),
    )
    joined = state.join(changes, [*keys, "generation"], "full")
    patched = F.coalesce("patched", F.lit(False))
    tags = F.when(F.col("ta") == "[]", F.array().cast("array<string>")).when(F.col("ta").isNotNull(), text.tags(F.coalesce(F.from_json("ta", "array<string>"), F.array())))
    joined = joined.withColumns({"bo": F.when(patched, patch.merged(F.when(patched, F.col("body")), F.when(patched, F.col("edits")))).otherwise(F.col("bo")), "ta": tags})
    merged = joined.select(
        *keys, "generation", F.coalesce("parent_author", "pa").alias("parent_author"), F.coalesce("parent_permlink", "pp").alias("parent_permlink"), F.coalesce("ti", "title").alias("title"), F.coalesce("bo", "body").alias("body"),
        F.coalesce("ta", "tags").alias("tags"), F.coalesce("created", "c").alias("created"), F.greatest("updated", "u").alias("updated"), (F.coalesce("deleted", F.lit(False)) | F.coalesce("d", F.lit(False))).alias("deleted"), F.greatest("block_num", "b").alias("block_num"), F.coalesce("created_block", "cb").alias("created_block"),
    )
    return merged.where("created is not null")  # a deletion of a post that never was


def follow_documents(log: DataFrame) -> DataFrame:
    """(op_id, block_num, block_ts, follower, names, what) of well-formed follow operations; what: the first of its list, "" for none."""
    ops = oplog.custom(log).where((F.col("kind") == "follow") & (F.col("action") == "follow"))
    rows = oplog.parsed(ops, ["op_id", "block_num", "block_ts", "account"], F.from_json("data", "follower string, following string, what string").alias("d"))
    rows = rows.where((F.col("d.follower") == F.col("account")) & F.col("d.what").startswith("["))
    what, names = F.from_json("d.what", "array<string>"), F.from_json("d.following", "array<string>")
    rows = oplog.parsed(rows, ["op_id", "block_num", "block_ts", "account"], F.coalesce(F.get(what, 0), F.lit("")).alias("what"), F.when(F.col("d.following").startswith("["), names).otherwise(F.array("d.following")).alias("names"))
    return rows.select("op_id", "block_num", "block_ts", F.col("account").alias("follower"), "names", F.when(F.col("what").isin("true", "false"), "").otherwise(F.col("what")).alias("what"))


def fold_follows(state: DataFrame, log: DataFrame) -> DataFrame:
    """Edges of five kinds: follow, mute, blacklist, follow_blacklist, follow_mute.

    In strict order of operations, so that the result does not depend on how
    the log is cut.  Follow and mute exclude each other; the last action of a
    pair within each of four groups counts; a reset removes all edges of its
    kinds that are older than it.
    """
    return fold_follow_documents(state, follow_documents(log))


def fold_follow_documents(state: DataFrame, rows: DataFrame) -> DataFrame:
    """``fold_follows`` of documents that are parsed already; it reads them twice."""
    group = {"": "pair", "blog": "pair", "follow": "pair", "ignore": "pair", "blacklist": "blacklist", "unblacklist": "blacklist", "follow_blacklist": "follow_blacklist", "unfollow_blacklist": "follow_blacklist", "follow_muted": "follow_mute", "unfollow_muted": "follow_mute"}
    made = {"blog": "follow", "follow": "follow", "ignore": "mute", "blacklist": "blacklist", "follow_blacklist": "follow_blacklist", "follow_muted": "follow_mute"}
    resets = {"reset_blacklist": ["blacklist"], "reset_following_list": ["follow"], "reset_muted_list": ["mute"], "reset_follow_blacklist": ["follow_blacklist"], "reset_follow_muted_list": ["follow_mute"], "reset_all_lists": ["follow", "mute", "blacklist", "follow_blacklist", "follow_mute"]}
    lookup = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), "what")
    actions = oplog.parsed(rows.select("op_id", "block_num", "follower", F.explode("names").alias("following"), "what"), ["op_id", "block_num", "follower", "following"], lookup(group).alias("grp"), lookup(made).alias("kind"))
    actions = actions.where("grp is not null and following is not null and following <> follower")
    old = state.select("op_id", "block_num", "follower", "following", "grp", "kind")
    # Kinds are numbers in the aggregation, which is by hash then and sorts nothing.
    kinds = F.array(*[F.lit(k) for k in resets["reset_all_lists"]])
    numbered = actions.unionByName(old).withColumn("n", F.array_position(kinds, F.col("kind")))
    last = numbered.groupBy("follower", "following", "grp").agg(F.max_by("n", "op_id").alias("n"), F.max_by("block_num", "op_id").alias("block_num"), F.max("op_id").alias("op_id"))
    last = last.select("follower", "following", "grp", F.get(kinds, (F.col("n") - 1).cast("int")).alias("kind"), "block_num", "op_id")
    cleared = rows.where(F.col("what").isin(*resets)).select("follower", "op_id", "block_num", F.explode(F.try_element_at(F.create_map(*[x for k, v in resets.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), "what")).alias("kind"))
    cleared = cleared.groupBy("follower", F.col("kind").alias("cleared_kind")).agg(F.max("op_id").alias("reset_op_id"), F.max_by("block_num", "op_id").alias("reset_block_num"))
    joined = last.join(cleared.withColumnRenamed("follower", "f"), (F.col("follower") == F.col("f")) & (F.col("kind") == F.col("cleared_kind")), "left")
    gone = F.coalesce(F.col("reset_op_id") > F.col("op_id"), F.lit(False))
    chosen = lambda name: F.when(gone, F.col(f"reset_{name}")).otherwise(F.col(name)).alias(name)
    return joined.select("follower", "following", "grp", F.when(~gone, F.col("kind")).alias("kind"), chosen("block_num"), chosen("op_id"))


def deletions(log: DataFrame) -> DataFrame:
    """(author, permlink, op_id, block_num) of the deletions of posts that had their effect."""
    keys = ["author", "permlink"]
    ops = oplog.scan(log, types=("delete_comment", "ineffective_delete")).select(*[oplog.field(k).alias(k) for k in keys], "op_id", "block_num", "op_type")
    spared = ops.where(F.col("op_type") == oplog.TYPES["ineffective_delete"]).select(*keys, "block_num").distinct()
    return ops.where(F.col("op_type") == oplog.TYPES["delete_comment"]).join(spared, [*keys, "block_num"], "left_anti").select(*keys, "op_id", "block_num")


def fold_reblogs(state: DataFrame, log: DataFrame) -> DataFrame:
    """The last of reblogging and deleting it counts for each account and post; a post that is deleted takes its reblogs along."""
    keys, post = ["account", "author", "permlink"], ["author", "permlink"]
    ops = oplog.custom(log).where(F.col("kind").isin("reblog", "follow") & (F.col("action") == "reblog"))
    rows = oplog.parsed(ops, ["op_id", "block_num", "block_ts", "account"], F.from_json("data", "account string, author string, permlink string, delete string").alias("d"))
    rows = rows.where(F.col("d.account") == F.col("account")).select("account", F.col("d.author").alias("author"), F.col("d.permlink").alias("permlink"), "op_id", "block_num", "block_ts", (F.coalesce("d.delete", F.lit("")) == "delete").alias("gone"))
    wiped = deletions(log).groupBy(*post).agg(F.max(F.struct("op_id", "block_num")).alias("wipe"))
    own = F.max(F.when(F.col("gone"), F.col("op_id"))).over(Window.partitionBy(*keys))  # the last deletion of this reblog
    newer = _newer(rows, state, keys).join(wiped, post, "left").withColumn("cleared", F.greatest(own, F.col("wipe.op_id")))
    since = newer.withColumn("since", F.when(~F.col("gone") & (F.col("cleared").isNull() | (F.col("op_id") > F.col("cleared"))), F.col("block_ts")))
    last = since.groupBy(*keys).agg((F.max_by("gone", "op_id") | F.coalesce(F.max("wipe.op_id") > F.max("op_id"), F.lit(False))).alias("gone"), F.max("block_num").alias("b"), F.min("since").alias("since"), F.max("cleared").alias("cleared"))
    held = state.join(wiped, post, "left").withColumn("wipe", F.when(F.col("wipe.block_num") > F.col("block_num"), F.col("wipe")))
    joined = held.join(last, keys, "full").withColumn("now_gone", F.coalesce("gone", F.when(F.col("wipe").isNotNull(), True), "deleted"))
    # A reblog that stands keeps its first time; one made again after its deletion has a new one, a deleted one none.
    stood = F.coalesce(~F.col("deleted"), F.lit(False)) & F.col("cleared").isNull()
    return joined.select(
        *keys, F.when(F.col("now_gone"), F.lit(None)).when(stood, F.col("created")).otherwise(F.col("since")).cast("timestamp_ntz").alias("created"),
        F.col("now_gone").alias("deleted"), F.greatest("b", "wipe.block_num", "block_num").alias("block_num"),
    )


def counted_votes(votes: DataFrame, posts: DataFrame) -> DataFrame:
    """Votes on live posts that aren't older than the post as it stands."""
    live = posts.where("not deleted").select(F.col("author").alias("a"), F.col("permlink").alias("p"), "created")
    return votes.join(live, (F.col("author") == F.col("a")) & (F.col("permlink") == F.col("p")) & (F.coalesce("last_update", "created") >= F.col("created")), "left_semi")


def fold_options(state: DataFrame, log: DataFrame) -> DataFrame:
    """The last options of each post; what is absent has its default, beneficiaries come from the extensions."""
    keys = ["author", "permlink"]
    rows = oplog.scan(log, types=("comment_options",)).select(
        *[oplog.field(k).alias(k) for k in keys], "op_id", "block_num", F.coalesce(oplog.field("max_accepted_payout"), F.lit("1000000.000 HBD")).alias("max_payout"),
        F.coalesce(oplog.field("percent_hbd").try_cast("int"), F.lit(10000)).alias("percent"), F.coalesce(oplog.field("allow_votes").try_cast("boolean"), F.lit(True)).alias("allow_votes"),
        F.coalesce(oplog.field("allow_curation_rewards").try_cast("boolean"), F.lit(True)).alias("allow_curation"), F.coalesce(oplog.field("extensions[0].value.beneficiaries"), F.lit("[]")).alias("beneficiaries"),
    )
    kept = ["max_payout", "percent", "allow_votes", "allow_curation", "beneficiaries", "block_num"]
    last = _newer(rows, state, keys).groupBy(*keys).agg(F.max_by(F.struct(*kept), "op_id").alias("l"))
    return state.join(last, keys, "full").select(*keys, *[F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(c)).alias(c) for c in kept])


def fold_last_reads(state: DataFrame, log: DataFrame) -> DataFrame:
    """Until when each account has read its notifications: what the last operation says, but no later than its block."""
    ops = oplog.custom(log).where((F.col("kind") == "notify") & (F.col("action") == "setLastRead"))
    said = F.get_json_object("data", "$.date").try_cast("timestamp_ntz")
    rows = ops.select("account", "op_id", "block_num", F.least(F.coalesce(said, F.col("block_ts")), F.col("block_ts")).alias("at"))
    last = _newer(rows, state, ["account"]).groupBy("account").agg(F.max_by(F.struct("at", "block_num"), "op_id").alias("l"))
    return state.join(last, "account", "full").select("account", F.coalesce("l.at", "read_at").alias("read_at"), F.coalesce("l.block_num", "block_num").alias("block_num"))


def fold_payouts(state: DataFrame, log: DataFrame) -> DataFrame:
    """Pending amounts from effective votes until a reward pays the post out."""
    keys = ["author", "permlink"]
    ops = oplog.scan(log, types=("effective_vote", "comment_reward", "payout_update"))
    amount = lambda name: F.coalesce((F.get_json_object("body", f"$.{name}.amount").try_cast("decimal(20,3)") / 1000).cast("decimal(20,3)"), F.split(oplog.field(name), " ")[0].try_cast("decimal(20,3)"))
    is_type = lambda t: F.col("op_type") == oplog.TYPES[t]
    rows = ops.select(*[oplog.field(k).alias(k) for k in keys], "op_id", "block_num", F.when(is_type("effective_vote"), amount("pending_payout")).alias("q"), F.when(is_type("comment_reward"), amount("total_payout_value")).alias("v"), F.when(~is_type("effective_vote"), F.col("block_ts")).alias("t"))
    changes = _newer(rows, state, keys).groupBy(*keys).agg(_last(F.col("q")).alias("q"), F.sum("v").alias("v"), F.max("t").alias("t"), F.max("block_num").alias("b"))
    paid = F.coalesce("is_paid", F.lit(False)) | F.col("t").isNotNull()
    nothing = F.lit(0).cast("decimal(20,3)")
    return state.join(changes, keys, "full").select(
        *keys, (F.coalesce("payout", nothing) + F.coalesce("v", nothing)).cast("decimal(20,3)").alias("payout"), F.when(paid, nothing).otherwise(F.coalesce("q", "pending", nothing)).cast("decimal(20,3)").alias("pending"),
        paid.alias("is_paid"), F.greatest("last_payout", "t").alias("last_payout"), F.greatest("block_num", "b").alias("block_num"),
    )


def post_tags(posts: DataFrame, reblogs: DataFrame | None = None) -> DataFrame:
    """(author, permlink, tag) of live posts."""
    return posts.where("not deleted").select("author", "permlink", F.explode("tags").alias("tag")).distinct()


def feed_entries(posts: DataFrame, reblogs: DataFrame) -> DataFrame:
    """(account, author, permlink, created): own live root posts and reblogs, each once."""
    live = posts.where("not deleted and coalesce(parent_author, '') = ''")
    own = live.select(F.col("author").alias("account"), "author", "permlink", "created")
    shown = posts.where("not deleted").select("author", "permlink")
    shared = reblogs.where("not deleted").join(shown, ["author", "permlink"], "left_semi").select("account", "author", "permlink", "created")
    return own.unionByName(shared).groupBy("account", "author", "permlink").agg(F.min("created").alias("created"))


# Roles by rank; least role of an actor for each action.
ROLES = {"muted": -2, "guest": 0, "member": 2, "mod": 4, "admin": 6, "owner": 8}
NEEDS = {"setRole": 4, "setUserTitle": 4, "mutePost": 4, "unmutePost": 4, "pinPost": 4, "unpinPost": 4, "updateProps": 6}
MOST_MODS = 100
#: Keys of the documents of each action, all texts; actions that aren't listed are no operations.
FIELDS = {
    "subscribe": (), "unsubscribe": (), "setRole": ("account", "role"), "setUserTitle": ("account", "title"), "updateProps": (),
    **{a: ("account", "permlink") for a in ("mutePost", "unmutePost", "pinPost", "unpinPost", "flagPost")},
}
ANYONE = ("subscribe", "unsubscribe")
MARKS = {"mutePost": ("muted", ""), "unmutePost": ("muted", None), "pinPost": ("pinned", ""), "unpinPost": ("pinned", None), "flagPost": ("flagged", "")}
KEPT = ("title", "about", "lang", "is_nsfw", "description", "flag_text", "settings")
PROPS = {"title": 20, "about": 120, "lang": 2, "description": 1000, "flag_text": 1000}
#: kind: role, title, subscriber, muted, pinned, flagged or prop; value is null where the key has it no longer.
COMMUNITIES = "community string, kind string, key string, value string, block_num int"
OPERATIONS = "community string, op_id long, block_num int, account string, action string, other string, role string, kind string, key string, value string"
ROLE_CHANGES = "community string, account string, op_id long, block_num int, rank int"


def _entries(account: str, action: str, doc: dict) -> list[tuple[str | None, str | None, str | None]]:
    """What a well-formed operation sets if its actor may, as (kind, key, value); one without any for a change of roles."""
    post = f"{doc.get('account')}/{doc.get('permlink')}"
    if action in ANYONE:
        return [("subscriber", account, "" if action == "subscribe" else None)]
    if action == "setUserTitle":
        return [("title", doc["account"], doc["title"] or None)]
    if action == "updateProps":
        return [("prop", k, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))) for k, v in doc["props"].items() if k in KEPT and v is not None]
    if action in MARKS:
        return [(MARKS[action][0], post, MARKS[action][1])]
    return [(None, None, None)]


def _well_formed(action: str, doc: object) -> bool:
    """An operation whose document has what its action needs, in the right types."""
    if action not in FIELDS or not isinstance(doc, dict) or not all(isinstance(doc.get(k), str) for k in FIELDS[action]):
        return False
    if action == "setRole":
        return doc["role"] in ROLES
    if action != "updateProps":
        return True
    props = doc.get("props")
    if not isinstance(props, dict) or not props:
        return False
    good = all(isinstance(props[k], str) and len(props[k]) <= most for k, most in PROPS.items() if k in props)
    return good and ("lang" not in props or props["lang"] in text.LANGUAGES) and ("is_nsfw" not in props or isinstance(props["is_nsfw"], bool))


def _read_operations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each operation's entries; of a bad one its place alone, without an action."""
    for source in batches:
        out: list[tuple] = []
        for community, op_id, block, account, action, data in zip(*(c.to_pylist() for c in source.columns), strict=True):
            doc = json.loads(data)
            if _well_formed(action, doc):
                out.extend((community, op_id, block, account, action, doc.get("account") if action == "setRole" else None, doc.get("role") if action == "setRole" else None, *e) for e in _entries(account, action, doc))
            else:
                out.append((community, op_id, block, account, *[None] * 6))
        yield _batch(out, OPERATIONS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _role_changes(most_mods: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Roles of the state and accepted changes; rows come by community and op_id, those of the state (no actor) first. Holds the roles of one community."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roles, mods = None, {}, 0
        for source in batches:
            out: list[tuple] = []
            for community, op_id, block, actor, other, role in zip(*(source.column(c).to_pylist() for c in ("community", "op_id", "block_num", "account", "other", "role")), strict=True):
                if community != now:
                    now, roles, mods = community, {community: ROLES["owner"]}, 0
                new, old = ROLES[role], roles.get(other, 0)
                if actor is not None:
                    rank = roles.get(actor, 0)
                    full = most_mods is not None and new == ROLES["mod"] and mods >= most_mods
                    if rank < NEEDS["setRole"] or new == old or rank <= new or rank <= old or old >= ROLES["owner"] or full:
                        continue
                out.append((community, other, op_id, block, new))  # those of the state too: they hold for what follows
                roles[other] = new
                mods += (new == ROLES["mod"]) - (old == ROLES["mod"])
            yield _batch(out, ROLE_CHANGES)

    return changes


def community_roles(state: DataFrame, log: DataFrame, most_mods: int | None = MOST_MODS) -> tuple[DataFrame, DataFrame]:
    """Operations of a batch that are new to communities, and (community, account, op_id, block_num, rank) of the roles there.

    Roles of the state come first, then owners, then accepted changes, so that
    the role at an operation is the last one before it.
    """
    ops = oplog.custom(log).where((F.col("kind") == "community") & F.col("data").startswith("{"))
    ops = ops.select(F.get_json_object("data", "$.community").alias("community"), "op_id", "block_num", "account", "action", "data").where(text.is_community(F.col("community")))
    rows = _newer(ops.mapInArrow(_read_operations, OPERATIONS), state, ["community"])
    known = state.where("kind = 'role' and value is not null").select("community", F.lit(-2).cast("long").alias("op_id"), "block_num", F.lit(None).cast("string").alias("account"), F.col("key").alias("other"), F.col("value").alias("role"))
    asked = rows.where("action = 'setRole'").select(*known.columns).unionByName(known)
    changes = asked.repartition("community").sortWithinPartitions("community", "op_id").mapInArrow(_role_changes(most_mods), ROLE_CHANGES)
    owners = rows.groupBy("community").agg(F.max("block_num").alias("block_num")).select("community", F.col("community").alias("account"), F.lit(-1).cast("long").alias("op_id"), "block_num", F.lit(ROLES["owner"]).alias("rank"))
    return rows, changes.unionByName(owners)


def fold_communities(state: DataFrame, log: DataFrame, most_mods: int | None = MOST_MODS) -> DataFrame:
    """Roles, titles, subscribers, marks of posts and properties of communities.

    Whether a role may be given depends on the roles before, so these few
    operations are read in order, a community at a time.  All others are
    judged by what their actor's role was then (a window by community and
    actor) and the last accepted one of each key counts, so that a community
    with most of the log is spread by actor and key.  A community takes no more
    moderators than ``most_mods`` (any number for None).
    """
    rows, roles = community_roles(state, log, most_mods)
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    name = F.try_element_at(table((r, n) for n, r in ROLES.items() if r), "rank")  # a guest has none
    held = roles.select("*", F.lit("role").alias("kind"), F.col("account").alias("key"), name.alias("value"))
    shown = rows.where("kind is not null").select("community", "account", "op_id", "block_num", "action", "kind", "key", "value").unionByName(held, allowMissingColumns=True)
    before = Window.partitionBy("community", "account").orderBy("op_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    had = F.coalesce(F.last("rank", ignorenulls=True).over(before), F.lit(0))
    least = F.try_element_at(table((a, NEEDS.get(a, min(ROLES.values()) if a in ANYONE else 0)) for a in FIELDS), "action")
    allowed = shown.withColumn("had", had).where(F.col("action").isNull() | (F.col("had") >= least))

    keys = ["community", "kind", "key"]
    last = allowed.groupBy(*keys).agg(F.max_by(F.struct("value", "block_num"), "op_id").alias("l"))
    chosen = lambda name: F.when(F.col("l").isNotNull(), F.col(f"l.{name}")).otherwise(F.col(name)).alias(name)
    return state.join(last, keys, "full").select(*keys, chosen("value"), chosen("block_num"))


def community_entries(state: DataFrame) -> DataFrame:
    """(community, kind, key, value) of what communities have now; a post's marks in one row of kind ``post``."""
    now, mark = state.where("value is not null"), F.col("kind").isin("muted", "pinned", "flagged")
    marks = now.where(mark).groupBy("community", "key").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("value"))  # three at most
    return now.where(~mark).select("community", "kind", "key", "value").unionByName(marks.select("community", F.lit("post").alias("kind"), "key", "value"))


def community_states(log: DataFrame) -> DataFrame:
    """Entries of communities after a log."""
    return community_entries(fold_communities(log.sparkSession.createDataFrame([], COMMUNITIES), log))

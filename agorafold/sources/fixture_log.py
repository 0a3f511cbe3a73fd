"""Operation logs made from the given tables, one per kind of operation.

Blocks are days: number ``FIRST`` + days since 1992-01-01.  An operation's id
is its block times ``SPAN`` plus its order within the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.sources import oplog, tables

FIRST, SPAN = 1_000_000, 1_000_000_000_000
EPOCH = "1992-01-01"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _day(at: Column) -> Column:
    return F.datediff(at.cast("date"), F.lit(EPOCH).cast("date"))


def _operations(rows: DataFrame, kind: str, day: Column, order: Column, **body: Column) -> DataFrame:
    block = (F.lit(FIRST) + day).cast("int")
    at = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days=day.cast("int"))
    return rows.select((block.cast("long") * SPAN + order).alias("op_id"), block.alias("block_num"), at.alias("block_ts"), F.lit(oplog.TYPES[kind]).alias("op_type"), F.to_json(F.struct(*[c.alias(k) for k, c in body.items()])).alias("body"))


def _custom(rows: DataFrame, kind: str, action: str, day: Column, order: Column, signer: Column, **data: Column) -> DataFrame:
    document = F.concat(F.lit(f'["{action}",'), F.to_json(F.struct(*[c.alias(k) for k, c in data.items()])), F.lit("]"))
    return _operations(rows, "custom_json", day, order, id=F.lit(kind), required_posting_auths=F.array(signer), json=document)


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is created; every third one fills in a profile later."""
    people = tables.read(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), _text("c", F.col("c_custkey"))
    profile = _text('{"profile":{"name":"', F.col("c_name"), '"}}')
    return _union(
        _operations(people, "account_create", k % 100, k, new_account_name=name, json_metadata=F.lit("")),
        _operations(people.where(k % 3 == 0), "account_update2", k % 100 + 200, k, account=name, posting_json_metadata=profile, json_metadata=F.lit("")),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item votes; final ones have their effect at once."""
    items = tables.read(spark, sf_dir, "lineitem")
    # Line numbers repeat within orders of the given tables; parts tell them apart.
    order = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey") % 100_000) * 2
    names = {"voter": _text("s", F.col("l_suppkey")), "author": _text("x", F.col("l_orderkey") % 100), "permlink": _text("p", F.col("l_orderkey"))}
    rshares = F.round(F.col("l_extendedprice") * 100).cast("long")
    return _union(
        _operations(items, "vote", _day(F.col("l_shipdate")), order, **names, weight=(F.col("l_quantity") * 100).cast("int")),
        _operations(items.where("l_linestatus = 'F'"), "effective_vote", _day(F.col("l_shipdate")), order + 1, **names, rshares=rshares, total_vote_weight=F.col("l_partkey")),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a post; every fourth is edited, some are deleted and half of those written again."""
    orders = tables.read(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), _day(F.col("o_orderdate"))
    names = {"author": _text("c", F.col("o_custkey")), "permlink": _text("p", k)}
    tags = F.to_json(F.struct(F.array(_text("#", F.col("o_orderpriority")), _text("T", k % 5), _text("t", k % 5)).alias("tags")))
    written = {**names, "parent_author": F.when(k % 10 == 0, "").otherwise("x"), "parent_permlink": F.lit("q"), "title": F.col("o_orderpriority"), "json_metadata": tags}
    return _union(
        _operations(orders, "comment", day, k * 10, **written, body=_text("b", k)),
        _operations(orders.where(k % 4 == 0), "comment", day, k * 10 + 1, **written, body=_text("e", k)),
        _operations(orders.where(k % 50 == 7), "delete_comment", day, k * 10 + 2, **names),
        _operations(orders.where(k % 100 == 7), "comment", day + 1, k * 10 + 3, **written, body=_text("r", k)),
    )


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows, then mutes, then some are taken back; every thirteenth supplier resets all lists in between."""
    k = F.col("follower") + F.col("following")
    order = F.col("follower") * 1_000_000 + F.col("following") + 1
    names = {"follower": _text("s", F.col("follower")), "following": _text("c", F.col("following"))}
    of = lambda rows, day, what, order=order: _custom(rows, "follow", "follow", day, order, names["follower"], **names, what=F.array(F.lit(what)))
    follow, mute = tables.follows(spark, sf_dir), tables.mutes(spark, sf_dir)
    resets = tables.read(spark, sf_dir, "supplier").where("s_suppkey % 13 = 0").select(F.col("s_suppkey").alias("follower"), F.lit(0).alias("following"))
    return _union(of(follow, k % 100, "blog"), of(mute, k % 100 + 100, "ignore"), of(follow.where(k % 10 == 0), k % 100 + 200, ""), of(resets, F.lit(150), "reset_all_lists", F.lit(0)))


def reblogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply shares its parent; every sixth takes it back a day later."""
    rows = tables.replies(tables.posts(spark, sf_dir))
    day = _day(F.col("created"))
    names = {"account": _text("c", F.col("author")), "author": _text("x", F.col("parent") % 100), "permlink": _text("p", F.col("parent"))}
    return _union(
        _custom(rows, "reblog", "reblog", day, F.col("id") * 2, names["account"], **names),
        _custom(rows.where("id % 6 = 0"), "reblog", "reblog", day + 1, F.col("id") * 2 + 1, names["account"], **names, delete=F.lit("delete")),
    )


def payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post has half its price pending; final ones are paid out a week later."""
    orders = tables.read(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), _day(F.col("o_orderdate"))
    names = {"author": _text("c", F.col("o_custkey")), "permlink": _text("p", k)}
    amount = lambda share: F.struct(F.round(F.col("o_totalprice") * share).cast("long").cast("string").alias("amount"), F.lit(3).alias("precision"))
    done = orders.where("o_orderstatus = 'F'")
    return _union(
        _operations(orders, "effective_vote", day, k * 3, **names, voter=F.lit("v"), pending_payout=amount(500)),
        _operations(done, "comment_reward", day + 7, k * 3 + 1, **names, total_payout_value=amount(1000)),
        _operations(done, "payout_update", day + 7, k * 3 + 2, **names),
    )


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are communities: customers subscribe, some leave, suppliers get roles, and each is given a title."""
    name = lambda key: _text("hive-1", F.lpad(F.col(key).cast("string"), 5, "0"))
    people, staff, nations = (tables.read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    return _union(
        _custom(people, "community", "subscribe", F.lit(1), c, _text("c", c), community=name("c_nationkey")),
        _custom(people.where(c % 5 == 0), "community", "unsubscribe", F.lit(2), c, _text("c", c), community=name("c_nationkey")),
        _custom(staff, "community", "setRole", F.lit(3), s, name("s_nationkey"), community=name("s_nationkey"), account=_text("s", s), role=F.when(s % 2 == 1, "mod").otherwise("member")),
        _custom(staff.where(s % 4 == 0), "community", "setRole", F.lit(4), s, _text("s", s), community=name("s_nationkey"), account=name("s_nationkey"), role=F.lit("guest")),
        _custom(nations, "community", "updateProps", F.lit(5), F.col("n_nationkey"), name("n_nationkey"), community=name("n_nationkey"), props=F.struct(F.col("n_name").alias("title"))),
    )


def place(nation: Column) -> Column:
    """The community of a nation: a topic, a journal or a council."""
    return _text("hive-", nation % 3 + 1, F.lpad(nation.cast("string"), 5, "0"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth customer becomes a member of its nation's community on some day; half of these are guests again after 700 days."""
    people = tables.read(spark, sf_dir, "customer").where("c_custkey % 6 = 0")
    k, home = F.col("c_custkey"), place(F.col("c_nationkey"))
    give = lambda rows, day, role: _custom(rows, "community", "setRole", day, k, home, community=home, account=_text("c", k), role=F.lit(role))
    return _union(give(people, k % 1000, "member"), give(people.where(k % 12 == 0), k % 1000 + 700, "guest"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a post that mentions others, under the order a third of its number if there is one, else in its author's community; deletions and second lives as in ``posts``."""
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    above = orders.select(F.col("o_orderkey").alias("above"), F.col("o_custkey").alias("above_author"))
    homes = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("home_of"), "c_nationkey")
    rows = orders.withColumn("up", F.when(F.col("o_orderkey") % 10 != 0, F.expr("o_orderkey div 3"))).join(above, F.col("up") == F.col("above"), "left").join(homes, F.col("o_custkey") == F.col("home_of"), "left")
    k, day, author = F.col("o_orderkey"), _day(F.col("o_orderdate")), F.col("o_custkey")
    names = {"author": _text("c", author), "permlink": _text("p", k)}
    written = {**names, "parent_author": F.coalesce(_text("c", F.col("above_author")), F.lit("")), "parent_permlink": F.coalesce(_text("p", F.col("above")), place(F.coalesce("c_nationkey", F.lit(0)))), "title": F.lit("t"), "json_metadata": F.lit("{}")}
    body = _text("Thanks @C", author, ", @c", author % 97 + 1, " and @nobody", author % 5, "; mail me@c1.com. (@c", k % 13 + 1, ")")
    return _union(
        _operations(rows, "comment", day, k * 10, **written, body=body),
        _operations(rows.where(k % 50 == 7), "delete_comment", day, k * 10 + 2, **names),
        _operations(rows.where(k % 100 == 7), "comment", day + 1, k * 10 + 3, **written, body=body),
    )


def thread_reblogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply in ``threads`` shares the post above it, two days later."""
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    above = orders.select(F.col("o_orderkey").alias("above"), F.col("o_custkey").alias("above_author"))
    rows = orders.where("o_orderkey % 10 <> 0").join(above, F.expr("o_orderkey div 3") == F.col("above"))
    names = {"account": _text("c", F.col("o_custkey")), "author": _text("c", F.col("above_author")), "permlink": _text("p", F.col("above"))}
    return _custom(rows, "reblog", "reblog", _day(F.col("o_orderdate")) + 2, F.col("o_orderkey"), names["account"], **names)


def thread_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as in ``votes``, on the posts of ``threads`` and ten thousand times as heavy."""
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = tables.read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey") % 100_000) * 2
    names = {"voter": _text("s", F.col("l_suppkey")), "author": _text("c", F.col("o_custkey")), "permlink": _text("p", F.col("l_orderkey"))}
    rshares = F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000
    return _union(
        _operations(items, "vote", _day(F.col("l_shipdate")), order, **names, weight=(F.col("l_quantity") * 100).cast("int")),
        _operations(items.where("l_linestatus = 'F'"), "effective_vote", _day(F.col("l_shipdate")), order + 1, **names, rshares=rshares, total_vote_weight=F.col("l_partkey")),
    )


def mute_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers mute suppliers who mute them, every fourth one mutes a customer, and every third follows another's mute list."""
    mutes, people = tables.mutes(spark, sf_dir), tables.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")

    def act(rows: DataFrame, who: Column, whom: Column, what: str, order: Column) -> DataFrame:
        return _custom(rows, "follow", "follow", F.lit(5), order, who, follower=who, following=whom, what=F.array(F.lit(what)))

    return _union(
        act(mutes, _text("c", F.col("following")), _text("s", F.col("follower")), "ignore", F.col("follower") * 1_000_000 + F.col("following")),
        act(people.where(k % 4 == 0), _text("c", k), _text("c", k % 97 + 1), "ignore", k + 500_000_000_000),
        act(people.where(k % 3 == 0), _text("c", k), _text("c", k % 50 + 1), "follow_muted", k + 600_000_000_000),
    )


def reputations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, reputation) of customers and suppliers, by their balance."""
    raw = lambda c: F.round(F.col(c) * 100).cast("long") * 1_000_000_000
    people = tables.read(spark, sf_dir, "customer").select(_text("c", F.col("c_custkey")).alias("name"), raw("c_acctbal").alias("reputation"))
    return people.unionByName(tables.read(spark, sf_dir, "supplier").select(_text("s", F.col("s_suppkey")).alias("name"), raw("s_acctbal").alias("reputation")))

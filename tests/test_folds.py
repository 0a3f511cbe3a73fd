"""Folds of a small log: results, repeated batches and any cut at block boundaries."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from agorafold.operators import fold_queries, folds, sums
from agorafold.sources import oplog, sinks
from agorafold.streaming import oplog_stream

START = datetime.datetime(2020, 1, 1)
C = "hive-123456"


def _custom(account, kind, action, data):
    return "custom_json", {"id": kind, "required_posting_auths": [account], "json": json.dumps([action, data])}


def _follow(a, b, what):
    return _custom(a, "follow", "follow", {"follower": a, "following": b, "what": [what] if what is not None else []})


def _community(actor, action, **data):
    return _custom(actor, "community", action, {"community": C, **data})


def _comment(author, permlink, body, parent="", tags=("x",)):
    return "comment", {"author": author, "permlink": permlink, "parent_author": parent, "parent_permlink": "p", "title": "T", "body": body, "json_metadata": json.dumps({"tags": list(tags)})}


BLOCKS = [
    [("account_create", {"new_account_name": n, "json_metadata": ""}) for n in ("ann", "bob", "cy")] + [("account_create", {"new_account_name": "ann", "json_metadata": "later"})],
    [("account_update2", {"account": "ann", "posting_json_metadata": '{"profile":{}}', "json_metadata": ""}), _comment("ann", "one", "first", tags=["#Tag A", "b"]), _comment("bob", "re", "reply", "ann")],
    [("vote", {"voter": "bob", "author": "ann", "permlink": "one", "weight": 10000}), ("effective_vote", {"voter": "bob", "author": "ann", "permlink": "one", "rshares": 500, "total_vote_weight": 70, "pending_payout": "1.500 HBD"})],
    [_follow("ann", "bob", "blog"), _follow("ann", "cy", "ignore"), _follow("bob", "ann", "blacklist"), _follow("cy", "ann", "blog"), _follow("cy", "bob", "follow_muted"), _follow("eve", "bob", "blog")],
    [("vote", {"voter": "bob", "author": "ann", "permlink": "one", "weight": -500}), ("effective_vote", {"voter": "bob", "author": "ann", "permlink": "one", "rshares": -7, "total_vote_weight": 3, "pending_payout": {"amount": "900", "precision": 3}})],
    [_comment("ann", "one", "edited", tags=["c"]), ("delete_comment", {"author": "bob", "permlink": "re"}), _comment("bob", "re", "again", "ann")],
    [_follow("ann", "cy", "blog"), _follow("ann", "bob", ""), _follow("cy", "all", "reset_all_lists"), _follow("cy", "bob", "blog"), _custom("cy", "reblog", "reblog", {"account": "cy", "author": "ann", "permlink": "one"})],
    [("delete_comment", {"author": "ann", "permlink": "one"}), ("ineffective_delete", {"author": "ann", "permlink": "one"}), ("custom_json", {"id": "follow", "required_posting_auths": ["ann"], "json": "not json"})],
    [("comment_reward", {"author": "ann", "permlink": "one", "total_payout_value": {"amount": "2500", "precision": 3}}), ("payout_update", {"author": "ann", "permlink": "one"}), _custom("bob", "reblog", "reblog", {"account": "bob", "author": "ann", "permlink": "one"})],
    [_custom("bob", "reblog", "reblog", {"account": "bob", "author": "ann", "permlink": "one", "delete": "delete"})],
    [_community(C, "setRole", account="ann", role="admin"), _community("ann", "setRole", account="bob", role="mod"), _community("bob", "setRole", account="cy", role="admin"), _community("bob", "mutePost", account="cy", permlink="z", notes="n")],
    [_community("bob", "setRole", account=C, role="guest"), _community("cy", "subscribe"), _community("ann", "subscribe"), _community("ann", "unsubscribe"), _community("cy", "pinPost", account="ann", permlink="one"), _community("ann", "updateProps", props={"title": "New", "bad": 1})],
]


@pytest.fixture(scope="module")
def rows():
    out = []
    for b, ops in enumerate(BLOCKS, 1):
        for name, body in ops:
            out.append((len(out), b, START + datetime.timedelta(seconds=3 * b), oplog.TYPES[name], json.dumps(body)))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, oplog.SCHEMA)


def _fold(spark, log, name, cuts):
    fold, schema = oplog_stream.FOLDS[name]
    state, low = spark.createDataFrame([], schema), 1
    for high in [*cuts, len(BLOCKS)]:
        found = fold(state, oplog.scan(log, low, high))
        state = spark.createDataFrame(found.select(*state.columns).collect(), schema)  # a table, as between batches
        low = high + 1
    return state


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("name", sorted(oplog_stream.FOLDS))
def test_cuts_and_repeats_change_nothing(spark, log, name):
    whole = _fold(spark, log, name, [])
    expected = sorted(map(repr, whole.collect()))
    for cuts in ([3], [2, 5, 8]):
        assert sorted(map(repr, _fold(spark, log, name, cuts).select(*whole.columns).collect())) == expected
    fold, _ = oplog_stream.FOLDS[name]
    assert sorted(map(repr, fold(whole, log).select(*whole.columns).collect())) == expected
    for low, high in ((1, 4), (4, 7), (9, 9), (6, 11)):  # an older batch again
        assert sorted(map(repr, fold(whole, oplog.scan(log, low, high)).select(*whole.columns).collect())) == expected


def test_accounts(spark, log):
    assert _set(_fold(spark, log, "accounts", []), "name", "posting_metadata", "json_metadata") == {("ann", '{"profile":{}}', "later"), ("bob", None, None), ("cy", None, None)}


def test_votes(spark, log):
    (row,) = _fold(spark, log, "votes", []).collect()
    assert (row["rshares"], int(row["weight"]), row["percent"], row["num_changes"], row["is_effective"], row["block_num"]) == (-7_000_000, 3, -500, 1, True, 5)


def test_posts(spark, log):
    found = _fold(spark, log, "posts", [])
    assert _set(found, "author", "permlink", "generation", "body", "deleted") == {("ann", "one", 0, "edited", False), ("bob", "re", 0, "reply", True), ("bob", "re", 1, "again", False)}
    assert {r["author"]: r["tags"] for r in found.where("author = 'ann'").collect()} == {"ann": ["c"]}


def test_follows(spark, log):
    assert _set(_fold(spark, log, "edges", []).where("kind is not null"), "follower", "following", "kind") == {("ann", "cy", "follow"), ("bob", "ann", "blacklist"), ("cy", "bob", "follow")} | {("eve", "bob", "follow")}


def test_reblogs_payouts_and_feed(spark, log):
    reblogs = _fold(spark, log, "reblogs", [])
    assert _set(reblogs.where("not deleted"), "account", "author", "permlink") == {("cy", "ann", "one")}
    (row,) = _fold(spark, log, "payouts", []).collect()
    assert (float(row["payout"]), float(row["pending"]), row["is_paid"]) == (2.5, 0.0, True)
    assert _set(folds.feed_entries(_fold(spark, log, "posts", []), reblogs), "account", "author", "permlink") == {("ann", "ann", "one"), ("cy", "ann", "one")}


def test_communities(spark, log):
    assert _set(folds.community_states(log), "kind", "key", "value") == {
        ("role", C, "owner"), ("role", "ann", "admin"), ("role", "bob", "mod"), ("subscriber", "cy", ""), ("post", "cy/z", "muted"), ("prop", "title", "New"),
    }


def test_bad_community_operations_are_skipped(spark):
    bad = [
        _community(C, "setRole", account=["a"], role="mod"), _community(C, "setRole", account="bob", role=[]), _community(C, "setUserTitle", account="bob", title=5), _community(C, "updateProps", props=[1]),
        _community(C, "updateProps", props={"lang": "xx"}), _community(C, "dance"), _community(C, "pinPost", account="bob"), _custom(C, "community", "mutePost", {"community": C}), _community(C, "setRole", account="ann", role="mod"),
    ]
    found = folds.community_states(_log_of(spark, bad))
    assert _set(found, "kind", "key", "value") == {("role", C, "owner"), ("role", "ann", "mod")}


def test_an_action_counts_by_the_role_of_its_time(spark):
    ops = [
        _community("bob", "pinPost", account="ann", permlink="a"), _community(C, "setRole", account="bob", role="mod"), _community("bob", "pinPost", account="ann", permlink="b"), _community("bob", "setUserTitle", account="ann", title="T"),
        _community(C, "setRole", account="bob", role="muted"), _community("bob", "unpinPost", account="ann", permlink="b"), _community("bob", "flagPost", account="ann", permlink="b"), _community("cy", "flagPost", account="ann", permlink="b"),
        _community(C, "setUserTitle", account="ann", title=""), _community(C, "updateProps", props={"is_nsfw": True, "settings": {"x": 1}}), _community(C, "updateProps", props={"title": 5}), _community(C, "updateProps", props={}),
    ]
    expected = {("role", C, "owner"), ("role", "bob", "muted"), ("post", "ann/b", "flagged,pinned"), ("prop", "is_nsfw", "true"), ("prop", "settings", '{"x":1}')}
    assert _set(folds.community_states(_log_of(spark, ops)), "kind", "key", "value") == expected
    state = spark.createDataFrame([], folds.COMMUNITIES)
    log = spark.createDataFrame([(i, i, START, oplog.TYPES[name], json.dumps(body)) for i, (name, body) in enumerate(ops)], oplog.SCHEMA)
    for low, high in ((0, 1), (2, 4), (0, 3), (5, 11), (0, 11)):  # cut anywhere, with older parts again
        state = spark.createDataFrame(folds.fold_communities(state, oplog.scan(log, low, high)).collect(), folds.COMMUNITIES)
    assert _set(folds.community_entries(state), "kind", "key", "value") == expected


def test_no_more_than_100_moderators(spark):
    found = folds.community_states(_log_of(spark, [_community(C, "setRole", account=f"m{i}", role="mod") for i in range(103)]))
    assert found.where("value = 'mod'").count() == 100


def _log_of(spark, ops):
    return spark.createDataFrame([(i, 1, START, oplog.TYPES[name], json.dumps(body)) for i, (name, body) in enumerate(ops)], oplog.SCHEMA)


def test_bodies_are_patched(spark):
    ops = [_comment("ann", "x", "The quick brown fox"), _comment("ann", "x", "@@ -5,11 +5,9 @@\n quic\n-k bro\n+%25 re\n wn \n"), _comment("ann", "y", "@@ no patch"), _comment("ann", "z", "a b"), _comment("ann", "z", "@@ -1,3 +1,5 @@\n a b\n+ c\n")]
    state = folds.fold_posts(spark.createDataFrame([], folds.POSTS), _log_of(spark, ops))
    bodies = {r["permlink"]: r["body"] for r in state.collect()}
    assert bodies == {"x": "The quic% rewn fox", "y": "@@ no patch", "z": "a b c"}
    later = spark.createDataFrame([(9, 2, START, oplog.TYPES["comment"], json.dumps(_comment("ann", "z", "@@ -1,5 +1,3 @@\n-a \n b c\n")[1]))], oplog.SCHEMA)
    assert folds.fold_posts(state, later).where("permlink = 'z'").first()["body"] == "b c"


def test_options_last_reads_and_early_votes(spark):
    ops = [
        ("comment_options", {"author": "ann", "permlink": "x", "percent_hbd": 0, "extensions": [["0", {"beneficiaries": []}]]}), ("comment_options", {"author": "ann", "permlink": "x", "allow_votes": False}),
        _custom("ann", "notify", "setLastRead", {"date": "2019-05-01T00:00:00"}), _custom("bob", "notify", "setLastRead", {"date": "2030-01-01T00:00:00"}),
        ("effective_vote", {"voter": "bob", "author": "ann", "permlink": "x", "rshares": 3, "total_vote_weight": 1}),
    ]
    log = _log_of(spark, ops)
    (row,) = folds.fold_options(spark.createDataFrame([], folds.OPTIONS), log).collect()
    assert (row["percent"], row["allow_votes"], row["max_payout"], row["beneficiaries"]) == (10000, False, "1000000.000 HBD", "[]")
    assert {r["account"]: str(r["read_at"]) for r in folds.fold_last_reads(spark.createDataFrame([], folds.LAST_READS), log).collect()} == {"ann": "2019-05-01 00:00:00", "bob": str(START)}
    assert folds.fold_votes(spark.createDataFrame([], folds.VOTES), log).first()["rshares"] == 3_000_000


def test_votes_before_the_post_do_not_count(spark):
    votes = spark.createDataFrame([("v", "ann", p, 1, 1, 1, START + datetime.timedelta(days=d), 0, True, 1) for p, d in (("x", 0), ("x", 2), ("gone", 2))], "voter string, author string, permlink string, weight int, rshares long, percent int, last_update timestamp_ntz, num_changes int, is_effective boolean, block_num int")
    posts = spark.createDataFrame([("ann", p, 0, "", "", "", "", [], START + datetime.timedelta(days=1), START, p == "gone", 1, 1) for p in ("x", "gone")], folds.POSTS)
    assert folds.counted_votes(votes, posts).count() == 1


def test_blocks_and_json(spark, log):
    blocks = oplog.blocks(log).orderBy("block_num").collect()
    assert len(blocks) == len(BLOCKS) and blocks[0]["previous_ts"] == blocks[0]["block_ts"] and blocks[3]["previous_ts"] == blocks[2]["block_ts"]
    assert json.loads(sinks.as_json(spark.range(1)).collect()[0]["json"]) == {"id": 0}


def test_block_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"5": {"transactions": [{"operations": [{"type": "vote_operation", "value": {"voter": "a"}}, {"type": "comment", "value": {"author": "b"}}]}]}}))
    found = oplog.from_block_files(spark, f"file://{tmp_path}/b.json").orderBy("op_id").collect()
    assert [(r["block_num"], r["op_type"], json.loads(r["body"])) for r in found] == [(5, 0, {"voter": "a"}), (5, 1, {"author": "b"})]
    assert str(found[0]["block_ts"]) == "2016-03-24 16:05:15"


def test_stream_equals_batch(spark, rows, log, tmp_path):
    source = f"file://{tmp_path}/log"
    for low, high in ((1, 4), (5, 9), (10, 12)):
        spark.createDataFrame([r for r in rows if low <= r[1] <= high], oplog.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query = oplog_stream.start(spark, source, f"file://{tmp_path}/state", f"file://{tmp_path}/check", files=1)
    query.awaitTermination()
    assert query.exception() is None
    state = f"file://{tmp_path}/state"
    kept = {}
    for name, (_, schema) in oplog_stream.FOLDS.items():
        expected = _fold(spark, log, name, [])
        kept[name] = sorted(map(repr, expected.collect()))
        assert sorted(map(repr, sinks.read_snapshot(spark, state, name, 2, schema).collect())) == kept[name], name
    empty = lambda schema: spark.createDataFrame([], schema)
    for name, (of, changes, group, count, schema) in oplog_stream.SUMS.items():  # kept over three batches, and from scratch
        whole = sums.merged(empty(schema), changes(empty(oplog_stream.FOLDS[of][1]), _fold(spark, log, of, [])), group, count)
        assert whole.count() and sorted(map(repr, sinks.read_snapshot(spark, state, name, 2, schema).collect())) == sorted(map(repr, whole.collect())), name
    later = oplog.scan(log, 10, 12)
    for version in (2, 3):  # the last batch again, as a retry and as another batch
        oplog_stream.fold_batch(spark, later, state, version)
        for name, (_, schema) in oplog_stream.FOLDS.items():
            assert sorted(map(repr, sinks.read_snapshot(spark, state, name, version, schema).collect())) == kept[name], name


def test_a_batch_writes_only_the_buckets_it_names(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    logs = [[("account_create", {"new_account_name": f"a{i}"}) for i in range(40)], [("account_update", {"account": "a7", "json_metadata": "x"})], [("account_update", {"account": "a7", "json_metadata": "y"})], []]
    for version, ops in enumerate(logs):
        log = spark.createDataFrame([(100 * version + i, version + 1, START, oplog.TYPES[name], json.dumps(body)) for i, (name, body) in enumerate(ops)], oplog.SCHEMA)
        oplog_stream.fold_batch(spark, log, state, version)
    rows = sinks.read_snapshot(spark, state, "accounts", 3, folds.ACCOUNTS)
    assert rows.count() == 40 and rows.where("json_metadata is not null").select("name", "json_metadata").collect() == [("a7", "y")]
    folders = [p.parts[-2:] for p in (tmp_path / "state" / "accounts").glob("version=*/bucket=*")]
    (changed,) = {b for v, b in folders if v == "version=2"}
    assert sorted(v for v, b in folders if b == changed) == ["version=2"]  # older ones of it are gone
    assert {v for v, b in folders if b != changed} == {"version=0"}


def test_a_deleted_post_takes_what_hangs_on_it_along(spark, tmp_path):
    """Reblogs, feed rows and tags go in the version of the deletion; a post that is written again starts without them."""
    state, after = f"file://{tmp_path}/state", {}
    write = lambda author, link, tag: ("comment", {"author": author, "permlink": link, "parent_author": "", "parent_permlink": "", "title": "", "body": "b", "json_metadata": json.dumps({"tags": [tag]})})
    share = lambda who, author, link, **more: ("custom_json", {"id": "reblog", "required_posting_auths": [who], "json": json.dumps(["reblog", {"account": who, "author": author, "permlink": link, **more}])})
    batches = [
        [write("ann", "x", "one"), write("ann", "y", "two"), share("bob", "ann", "x"), share("cat", "ann", "x"), share("bob", "ann", "y")],
        [("delete_comment", {"author": "ann", "permlink": "x"}), ("delete_comment", {"author": "ann", "permlink": "y"}), ("ineffective_delete", {"author": "ann", "permlink": "y"})],
        [write("ann", "x", "three"), share("cat", "ann", "x")],
        [share("dan", "ann", "x"), ("delete_comment", {"author": "ann", "permlink": "x"}), write("ann", "x", "four"), share("eve", "ann", "x")],
    ]
    log, logs = [], []
    for version, ops in enumerate(batches):
        rows = [(100 * version + i, version + 1, START + datetime.timedelta(days=version), oplog.TYPES[name], json.dumps(body)) for i, (name, body) in enumerate(ops)]
        # One operation a block, but for the deletions, whose answers are in their block.
        rows = [(i, b * 100 + (0 if version == 1 else k), t, n, x) for k, (i, b, t, n, x) in enumerate(rows)]
        log += rows
        logs.append(spark.createDataFrame(rows, oplog.SCHEMA))
        for _ in range(2 if version == 1 else 1):
            oplog_stream.fold_batch(spark, logs[-1], state, version)
        read = lambda name, schema, version=version: sinks.read_snapshot(spark, state, name, version, schema)
        feed = {(r["account"], r["permlink"]) for r in read("feed", folds.FEED).collect()}
        after[version] = feed, {(r["permlink"], r["tag"]) for r in read("tags", folds.TAGS).collect()}, {(r["account"], r["permlink"]) for r in read("reblogs", folds.REBLOGS).where("not deleted").collect()}
    whole = spark.createDataFrame(log, oplog.SCHEMA)
    at_once = folds.feed_entries(*[fold(spark.createDataFrame([], schema), whole) for fold, schema in (oplog_stream.FOLDS[n] for n in ("posts", "reblogs"))])
    assert {(r["account"], r["permlink"]) for r in at_once.collect()} == feed
    assert after[0] == ({("ann", "x"), ("ann", "y"), ("bob", "x"), ("cat", "x"), ("bob", "y")}, {("x", "one"), ("y", "two")}, {("bob", "x"), ("cat", "x"), ("bob", "y")})
    assert after[1] == ({("ann", "y"), ("bob", "y")}, {("y", "two")}, {("bob", "y")})
    assert after[2] == ({("ann", "x"), ("ann", "y"), ("bob", "y"), ("cat", "x")}, {("x", "three"), ("y", "two")}, {("bob", "y"), ("cat", "x")})
    assert after[3] == ({("ann", "x"), ("ann", "y"), ("bob", "y"), ("eve", "x")}, {("x", "four"), ("y", "two")}, {("bob", "y"), ("eve", "x")})


def test_event_rates(spark, tmp_path):
    events = spark.createDataFrame([(i, START + datetime.timedelta(minutes=20 * i), "view", 1.0) for i in range(6)], "event_id long, ts timestamp_ntz, event_type string, value double")
    found = oplog_stream.event_rates(events).orderBy("start").collect()
    assert [(r["n"], r["total"]) for r in found] == [(3, 3.0), (3, 3.0)]
    assert events.where(F.col("ts") > START).count() == 5


def test_unpatched_posts_reach_python_without_null_arrays(spark):
    """F16, F17, F18: of a column of null arrays Spark reads all rows of an Arrow batch again at each row; metadata moved whole, to be read at each edit."""
    found = folds.fold_posts(spark.createDataFrame([], folds.POSTS), _log_of(spark, [_comment("ann", "x", "a"), _comment("ann", "x", "b")]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    argument = plan[plan.index("ArrowEvalPython") :].split("\n")[0]
    below = plan[plan.index("ArrowEvalPython") :].split("\n")[1]
    assert "coalesce" in argument + below
    assert "json_metadata" not in plan[: plan.rindex("Window")]
    assert [(r["body"], r["tags"]) for r in found.collect()] == [("b", ["x"])]


def test_follows_are_parsed_once_and_aggregated_by_hash(spark):
    plan = fold_queries.fold_follows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "from_json" not in plan

"""Scalar functions against known values."""

import json
import re

import pytest
from pyspark.sql import functions as F

from agorafold.functions import assets, bitmask, ids, profiles, ranking, reputation, text
from agorafold.operators import paging, search


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(("raw", "shown"), [(0, 25.0), (2321387987213, 55.29), (-2321387987213, -5.29), (5, 25.0)])
def test_reputation(spark, raw, shown):
    assert value(spark, reputation.display(F.lit(raw).cast("long"))) == pytest.approx(shown)


def test_reputation_score(spark):
    assert [value(spark, reputation.notification_score(F.lit(x).cast("long"))) for x in (0, 10**9, 10**11, -(10**11))] == [25, 25, 40, 10]


def test_ranking(spark):
    at = F.lit("1970-01-02 00:00:00").cast("timestamp_ntz")
    assert value(spark, ranking.hot(F.lit(10**10), at)) == pytest.approx(3 + 8.64)
    assert value(spark, ranking.trending(F.lit(-(10**10)), at)) == pytest.approx(-3 + 0.36)
    assert value(spark, ranking.hot(F.lit(0), at)) == pytest.approx(8.64)


def test_votes(spark):
    number = lambda x: F.lit(x).cast("long")
    assert value(spark, ranking.vote_value(F.lit(10.0), number(100), number(25))) == 2.5
    assert value(spark, ranking.vote_value(F.lit(10.0), number(0), number(25))) == 0
    scores = [value(spark, ranking.vote_score(F.lit(10.0), number(a), number(r))) for a, r in ((0, 1), (100000, 1), (1000, 3), (100, 3), (1, 100))]
    assert scores == [0, -1, 25, 50, 100]
    assert [value(spark, ranking.vote_payload(F.lit(x))) for x in (0.001, 1.234)] == ["", "($1.23)"]
    assert [value(spark, ranking.flag_weight(number(x))) for x in (5, -(10**12), -2 * 10**14)] == [0, 1, 4]


def test_assets(spark):
    parsed = value(spark, assets.parse(F.lit("1.001 SBD")))
    assert (float(parsed["amount"]), parsed["currency"]) == (1.001, "HBD")
    assert value(spark, assets.parse(F.lit("nothing"))) is None
    whole = value(spark, assets.from_object(F.lit(1231121), F.lit(6), F.lit("@@000000037")))
    assert (float(whole["amount"]), whole["currency"]) == (1.231121, "VESTS")
    assert tuple(value(spark, assets.to_object(F.lit("1.001").cast("decimal(10,3)"), F.lit("HBD")))) == ("1001", "@@000000013", 3)


def test_bits(spark):
    assert value(spark, bitmask.encode(F.array(F.lit(0), F.lit(2)))) == 5
    assert value(spark, bitmask.decode(F.lit(22))) == [1, 2, 4]
    assert value(spark, bitmask.names(F.lit(5))) == ["MUTED_COMMUNITY_MODERATION", "MUTED_PARENT"]
    assert bitmask.filter_mask([1, 4]) == 18
    with pytest.raises(ValueError, match="0 to 4"):
        bitmask.filter_mask([5])


def test_identifiers(spark):
    at = F.lit("2020-05-05 05:05:05").cast("timestamp_ntz")
    back = value(spark, ids.unpack(ids.pack(at, F.lit(17), F.lit(4194303))))
    assert (str(back["created"]), back["kind"], back["counter"]) == ("2020-05-05 05:05:05", 17, 4194303)


def test_texts(spark):
    body = "@alice hi @Bob.x, (@carol-1) mail@dave.org @eve! x@frank @alice @no"
    pattern = re.compile(text.MENTION)
    assert value(spark, text.mentions(F.lit(body))) == list(dict.fromkeys(m.lower() for m in pattern.findall(body)))
    assert value(spark, text.tags(F.array(*map(F.lit, ["#A b", "ab", "", "x" * 40])))) == ["ab", "x" * 32]
    assert [value(spark, text.is_account(F.lit(x))) for x in ("alice", "a", "Alice", "a-b.cde", "x" * 17)] == [True, False, False, True, False]
    assert [value(spark, text.json_date(F.lit(x).cast("timestamp_ntz"))) for x in ("2018-06-22 20:34:30", text.NEVER, None)] == ["2018-06-22T20:34:30", text.NO_DATE, text.NO_DATE]


@pytest.mark.parametrize(("posting", "other", "expected"), [
    ('{"profile": {"name": "n", "website": "x.org"}}', "", {"name": "n", "website": "http://x.org"}),
    ("broken", '{"profile": {"about": "%s"}}' % ("a" * 200), {"about": "a" * 157 + "..."}),
    ('{"name": "@bad", "location": "here", "cover_image": "ftp://x", "profile_image": "https://x/y"}', "", {"name": "", "location": "here", "cover_image": "", "profile_image": "https://x/y"}),
    (None, None, {"name": ""}), ("", "[1]", {"about": ""}), (json.dumps({"profile": {"name": "a" * 21}}), "", {"name": "a" * 17 + "..."}),
])
def test_profiles(spark, posting, other, expected):
    found = value(spark, profiles.profile(F.lit(posting).cast("string"), F.lit(other).cast("string"))).asDict()
    assert {k: found[k] for k in expected} == expected and all(v is not None for v in found.values())


def test_search_queries(spark):
    assert [(c.sign, c.field, c.words) for c in search.parse('+title:"a b" -c d "open end')] == [("+", "title", ("a", "b")), ("-", None, ("c",)), ("", None, ("d",)), ("", None, ("open", "end"))]
    rows = spark.createDataFrame([(1, "The cat sat", "x"), (2, "cat the", "y"), (3, None, "cat")], "id int, body string, title string")
    fields = {"body": F.col("body"), "title": F.col("title")}
    ids_of = lambda q, every=True: sorted(r["id"] for r in rows.where(search.predicate(q, fields, every)).collect())
    assert ids_of("cat") == [1, 2, 3] and ids_of('"the cat"') == [1] and ids_of("cat -title:x") == [2, 3] and ids_of("title:cat") == [3] and ids_of("sat y", False) == [1, 2] and ids_of("") == [1, 2, 3]


def test_pages_with_ties(spark):
    rows = spark.createDataFrame([(i, float(i // 3)) for i in range(20)], "id long, score double").withColumn("score", F.col("score").cast("float"))
    whole = [r["id"] for r in paging.top(rows, "score", 20).collect()]
    pages, last = [], None
    while True:
        found = [r["id"] for r in paging.page(rows, "score", last, 4).collect()]
        if not found:
            break
        pages += found
        last = found[-1]
    assert pages == whole and len(pages) == 20


def test_images_dates_numbers_and_languages(spark):
    from agorafold.functions import text

    good, long = "http://x.org/a.png", "http://" + "x" * 1100
    cases = {
        '{"image": ["%s"]}' % good: good, '{"image": "%s"}' % good: good, '{"image": []}': "", '{"image": [3]}': "", '{"image": "ftp://x"}': "", '{"image": {"a": 1}}': "", "": "", "no json": "", '{"image": ["%s"]}' % long: "",
        '{"image": [" HTTPS://x "]}': "HTTPS://x", '{"other": 1}': "",
    }
    rows = spark.createDataFrame([*cases.items(), (None, "")], "m string, e string").select("e", text.first_image(F.col("m")).alias("i")).collect()
    assert all(r["e"] == r["i"] for r in rows), rows
    times = spark.sql("select timestamp_ntz'2020-12-31 23:00:00' a, timestamp_ntz'2021-02-01 01:30:05' b")
    found = times.select(*[text.date_diff(u, F.col("a"), F.col("b")).alias(u) for u in ("year", "month", "week", "day", "hour", "minute", "second")]).first()
    assert tuple(found) == (1, 2, 4, 31, 746, 44790, 2687405)
    n = spark.createDataFrame([(9007199254740991,), (9007199254740992,), (-5,)], "n long").select(text.safe_integer(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in n] == ["9007199254740991", '"9007199254740992"', "-5"]
    one = spark.createDataFrame([("en", "a\0b"), ("xx", None)], "c string, b string").select(text.is_language(F.col("c")).alias("l"), text.without_nul(F.col("b")).alias("n")).collect()
    assert [tuple(r) for r in one] == [(True, "a b"), (False, None)]


def test_rules(spark):
    from agorafold.functions import rules

    rows = spark.createDataFrame([(True, 1, 0, False), (True, 2, 0, False), (True, 3, 2, False), (False, 2, 0, False), (False, 3, 0, True), (False, None, None, True)], "root boolean, kind int, role int, up boolean")
    found = [r["m"] for r in rows.select(rules.muted_reasons(F.col("root"), F.col("kind"), F.col("role"), F.col("up")).alias("m")).collect()]
    assert found == [0, 2, 0, 0, 6, 4]
    votes = spark.createDataFrame([("a", "b", 0, 10**10, 0.02, None), ("a", "a", 0, 10**10, 0.02, None), ("a", "b", 0, 10**9, 0.02, None), ("a", "b", -1, 10**10, 0.02, None), ("a", "b", 0, 10**10, 0.01, None), ("a", "b", 0, 10**10, 1.0, True)], "v string, a string, s int, w long, x double, m boolean")
    told = [r["t"] for r in votes.select(rules.vote_is_told(*[F.col(c) for c in "vaswxm"]).alias("t")).collect()]
    assert told == [True, False, False, False, False, False]
    docs = spark.createDataFrame([('{"account": "a", "role": "mod"}',), ('{"account": "a"}',), ('{"account": 1, "role": "mod"}',), ('{"account": "a", "role": "mod", "x": 1}',), ('{"account": "a", "role": "mod", "notes": "n"}',), ("[1]",), ("bad",)], "d string")
    valid = [r["v"] for r in docs.select(rules.payload_is_valid(F.col("d"), {"account": "string", "role": "string"}, {"notes": "string"}).alias("v")).collect()]
    assert valid == [True, False, False, False, True, False, False]

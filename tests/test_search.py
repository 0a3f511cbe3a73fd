"""Search from whole texts and from the index, against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from agorafold.operators import search, text_index
from agorafold.plans import api

SF_DIR = "/root/testdata/sf0.001"
FIELDS = "id long, title string, body string, lang string, source string"


def _plain_words(text):
    return re.findall("[a-z0-9]+", text.lower())


def _plain_search(docs, query):
    """{id: score} of (id, title, body, lang) rows by the rules of the query language."""
    clauses, n = search.parse(query), len(docs)
    words = {(i, f): _plain_words(v) for i, *values in docs for f, v in zip(("title", "body", "lang"), values)}
    fields = lambda c: [c.field] if c.field in ("title", "body", "lang") else ["title", "body"]
    times = lambda w, c: sum(tuple(w[k : k + len(c.words)]) == c.words for k in range(len(w)))
    mean = {f: sum(len(words[i, f]) for i, *_ in docs) / max(1, n) for f in ("title", "body", "lang")}
    rare = lambda t, f: math.log(1 + (n - (d := sum(t in words[i, f] for i, *_ in docs)) + 0.5) / (d + 0.5))
    out = {}
    for i, *_ in docs:
        hits = [any(times(words[i, f], c) for f in fields(c)) for c in clauses]
        if any(h == (c.sign == "-") for h, c in zip(hits, clauses)) or all(c.sign == "-" for c in clauses):
            continue
        score = 0.0
        for c in clauses:
            for f in fields(c):
                k = times(words[i, f], c)
                if k and c.sign != "-" and f != "lang":
                    score += sum(rare(t, f) for t in c.words) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(words[i, f]) / mean[f]))
        out[i] = round(score, 6)
    return out


QUERIES = ["red", "red blue", "+red -blue", '"red blue"', '"red blue red"', "-red", "-red lang:en", "title:red", 'body:"blue green" red', "lang:en", "unknown:red", "red-blue", "none", "red none", 'blue "red', '-"red blue" red', ""]


def _docs(n=60):
    colours = ["red", "blue", "green", "RED", "x1"]
    text = lambda i: " ".join(colours[(i * k * k + k) % 5] for k in range(1, 2 + i % 9))
    rows = [(i * 1500, text(i), text(i) + "\n" + text(i * 7 + 3), ["en", "de"][i % 2]) for i in range(n)]
    return [*rows, (-5, "red", "red", "en"), (-6, "", "", ""), (-7, "red, blue!", "Red: blue", "EN")]


def _same(found, wanted):
    assert found.keys() == wanted.keys() and all(abs(found[i] - wanted[i]) < 2e-6 for i in wanted)


def test_scan_equals_plain_search(spark):
    rows = spark.createDataFrame([(*d, "s") for d in _docs()], FIELDS)
    for query in QUERIES:
        _same({r["id"]: r["score"] for r in search.scan(rows, query).collect()}, _plain_search(_docs(), query))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Three batches: documents, of which some are changed, some deleted and some come back; the last is run twice."""
    root = str(tmp_path_factory.mktemp("index"))
    shape = "id long, title string, body string, lang string, deleted boolean"
    batch = lambda rows: spark.createDataFrame(rows, shape)
    docs = _docs()
    first = [(i, "old " + t if i % 4 == 0 else t, b[::-1] if i % 4 == 0 else b, g, False) for i, t, b, g in docs] + [(None, "red", "red", "en", False), (7, "gone red", "red", "en", False)]
    text_index.index_batch(batch(first), root, 1)
    text_index.index_batch(batch([(i, t, b, g, False) for i, t, b, g in docs if i % 8 == 0] + [(7, None, None, None, True), (1500, None, None, None, True)]), root, 2)
    last = [(i, t, b, g, None) for i, t, b, g in docs if i % 8 == 4 or i == 1500] + [(8, None, None, None, True)]
    text_index.index_batch(batch(last + last), root, 3)
    text_index.index_batch(batch(last), root, 3)
    return root


def test_index_equals_plain_search(spark, index):
    for query in QUERIES[2:13]:
        _same({r["id"]: r["score"] for r in text_index.Search(spark, index, 3, query).found().collect()}, _plain_search(_docs(), query))


def test_index_counts_terms_and_compacts(spark, index, tmp_path):
    want = {}
    for _, *values in _docs():
        for f, v in zip(("title", "body", "lang"), values):
            for w in set(_plain_words(v)):
                want[f, w] = want.get((f, w), 0) + 1
    target = str(tmp_path / "one")
    text_index.compact(spark, index, 3, target)
    for root in (index, target):
        assert {(r["field"], r["term"]): r["docs"] for r in text_index.term_counts(spark, root, 3).collect()} == want
    for query in ("red blue", '"red blue"', "+red -blue lang:en"):
        _same({r["id"]: r["score"] for r in text_index.Search(spark, target, 3, query).found().collect()}, _plain_search(_docs(), query))


def test_index_pages_by_bounds(spark, index, monkeypatch):
    for probe, queries in ((1, ("red blue", '"red blue"')), (8, ("red", "-blue red lang:en"))):
        monkeypatch.setattr(text_index, "PROBE", probe)
        for query in queries:
            found = text_index.Search(spark, index, 3, query)
            want = sorted(_plain_search(_docs(), query).items(), key=lambda x: (-x[1], -x[0]))
            first = found.page(4).collect()
            assert [r["id"] for r in first] == [i for i, _ in want[:4]]
            if len(want) > 4:
                assert [r["id"] for r in found.page(4, first[-1]["id"]).collect()] == [i for i, _ in want[4:8]]
    bounds = {(r["version"], r["block"]): r["bound"] for r in text_index.Search(spark, index, 3, "red blue").bounds().collect()}
    scores = _plain_search(_docs(), "red blue")
    assert len(bounds) > 8 and all(max(b for (_, k), b in bounds.items() if k == i >> text_index.BLOCK_BITS) >= s - 1e-6 for i, s in scores.items())


def test_index_reads_only_the_buckets_of_its_terms(spark, index):
    found = text_index.Search(spark, index, 3, "red")
    files = found._postings().inputFiles()
    assert files and {int(f.split("bucket=")[1].split("/")[0]) for f in files} == found.buckets and len(found.buckets) == 1


def test_index_writes_only_the_rows_of_its_batch_and_a_row_a_term(spark, index):
    batch = spark.read.parquet(f"{index}/docs/version=2")
    assert batch.count() == len([i for i, *_ in _docs() if i % 8 == 0] + [7, 1500])
    lists = spark.read.parquet(f"{index}/postings/version=1")
    assert lists.count() < lists.agg({"docs": "sum"}).first()[0]


def test_packed_postings_equal_plain_ones():
    ids, texts = np.array([5, -3, 2**62, -(2**62), 0, 10**12, 7]), ["", "a bb é a c1", "bb " * 400, "x" * 300, "a a c1 " * 70, "", "z é-z a"]
    want = {}
    for i, text in zip(ids.tolist(), texts, strict=True):
        for k, w in enumerate(found := _plain_words(text)):
            want.setdefault((w, i), (len(found), []))[1].append(k)
    lists = text_index._lists("body", ids, pa.array(texts)).append_column("version", pa.array([1] * 5, pa.int32()))
    for _ in range(2):
        each = [r for b in text_index._opened(iter([lists])) for r in b.to_pylist()]
        assert len(each) == len(want) and {(r["term"], r["id"]): (r["length"], r["positions"]) for r in each} == want
        whole = {}
        for r in each:
            whole.setdefault(r["term"], []).append({k: r[k] for k in ("id", "length", "positions")})
        kind = pa.list_(pa.struct([("id", pa.int64()), ("length", pa.int32()), ("positions", pa.list_(pa.int32()))]))
        rows = pa.RecordBatch.from_pydict({"field": ["body"] * 5, "term": list(whole), "list": pa.array(list(whole.values()), kind)})
        (again,) = text_index._repacked(iter([rows]))
        lists = again.append_column("version", pa.array([1] * 5, pa.int32()))
    assert text_index._lists("body", ids[:2], pa.array(["", "é"])).num_rows == 0


def test_empty_index(spark, tmp_path):
    root = str(tmp_path / "none")
    text_index.index_batch(spark.createDataFrame([], "id long, title string, body string, lang string, deleted boolean"), root, 1)
    assert text_index.Search(spark, root, 1, "red").page().count() == 0 and text_index.term_counts(spark, root, 1).count() == 0


def test_find_text_pages_are_disjoint(spark):
    first = [r["id"] for r in api.call("search_api.find_text", spark, SF_DIR, {"query": "the of", "limit": 5}).collect()]
    second = [r["id"] for r in api.call("search_api.find_text", spark, SF_DIR, {"query": "the of", "limit": 5, "last": first[-1]}).collect()]
    assert len(set(first + second)) == 10
    with_it = {r["id"] for r in api.call("search_api.find_text", spark, SF_DIR, {"query": "scum", "limit": 100}).collect()}
    without = {r["id"] for r in api.call("search_api.find_text", spark, SF_DIR, {"query": "scum -idiot", "limit": 100}).collect()}
    assert without < with_it

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agorafold.llm import quality_cnn, vector_codes, vectors, whitening, wordhash

VECTORS = "vec_id long, embedding array<float>, label int, n int, component string, x string, k long, v string, __pq_l string, __pq_s int"


def _table(spark, rows, kind="float"):
    """(vec_id, vector, label) rows with further columns whose names could clash."""
    return spark.createDataFrame([(*r, 1, "c", "x", 2, "v", "l", 3) for r in rows], VECTORS.replace("float", kind))


def _some(n=60, d=16, seed=3):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in draw.normal(0, 0.2, d).astype(np.float32)], None if i % 7 == 0 else i % 3) for i in range(n)]


BAD = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] + [0.0] * 15, 1), (903, [float("inf")] * 16, 1), (904, [float("-inf")] * 16, None), (905, [0.5] * 3, 1), (906, [], 1)]


def _brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks in plain integers; rows: (id, vector), ids distinct."""
    ints = [[math.floor(4096 * x) for x in v] for _, v in rows]
    w = len(ints[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    books = [[ints[i][p * w : (p + 1) * w] for i in order] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            won = [near(v[p * w : (p + 1) * w], books[p])[1] for v in ints]
            for k in range(len(books[p])):
                own = [v[p * w : (p + 1) * w] for v, e in zip(ints, won) if e == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = [[near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)] for v in ints]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{k:02x}" for _, k in o) for o in out], [sum(s for s, _ in o) for o in out], sha


def _codes(df):
    rows, length = vectors.usable(df)
    books = vector_codes.learn(rows, length)
    return vector_codes.encode(rows, books, length), books


def test_codes_equal_brute_force(spark):
    rows = _some() + [(100 + i, [0.25] * 16, 5) for i in range(40)]  # a hot vector, and ties
    coded, books = _codes(_table(spark, rows + BAD).repartition(5))
    got = {r["vec_id"]: r for r in coded.collect()}
    codes, errors, sha = _brute_codes([(r[0], r[1]) for r in rows])
    assert sorted(got) == sorted(r[0] for r in rows)
    assert [got[r[0]]["__pq_code"] for r in rows] == codes and [got[r[0]]["__pq_error"] for r in rows] == errors
    assert vector_codes.digest(books) == sha and coded.columns[:10] == [c.split()[0] for c in VECTORS.split(", ")]


@pytest.mark.parametrize("scale", [3e7, 1e20, 1e38])
def test_codes_of_large_numbers_are_exact(spark, scale):
    rows = [(i, [float(np.float32(x * scale)) for x in v], None) for i, v, _ in _some(30)] + _some(50)[30:]
    coded, books = _codes(_table(spark, rows, "double"))
    codes, errors, sha = _brute_codes([(r[0], r[1]) for r in rows])
    got = {r["vec_id"]: r for r in coded.collect()}
    assert [got[r[0]]["__pq_code"] for r in rows] == codes and vector_codes.digest(books) == sha
    assert [got[r[0]]["__pq_error"] for r in rows] == [e if e < 1 << 63 else None for e in errors]


def test_codes_edges(spark):
    empty, _ = _codes(_table(spark, []))
    assert empty.count() == 0 and _codes(_table(spark, BAD[:5]))[0].count() == 0
    one, books = _codes(_table(spark, [(None, [0.1] * 8, 1), (4, [0.2] * 8, 1), (4, [0.15] * 8, 1), (4, [0.2] * 8, 1)]))
    assert [len(b) for b in books] == [2] * 8 and {(r["vec_id"], r["__pq_code"]) for r in one.collect()} == {(4, "00" * 8), (None, "01" * 8)}
    uneven, books = _codes(_table(spark, [(i, [0.1 * i, -0.2, 0.3], 1) for i in range(20)]))
    assert [b.shape[1] for b in books] == [1, 1, 1, 0, 0, 0, 0, 0] and {len(r["__pq_code"]) for r in uneven.collect()} == {16}
    many, books = _codes(_table(spark, [(1, [float(i)] * 8, 1) for i in range(40)] + [(k, [0.0] * 8, 1) for k in range(2, 20)]))
    assert len(books[0]) == 16 and many.count() == 58
    assert vector_codes.cuts(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]


def test_label_errors_by_broadcast_and_by_salt(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, i) for i in range(100)] + [(200, 7, None), (201, 9, (1 << 63) - 1), (202, 9, 5)], "vec_id long, label int, error long")
    want = {}
    for i in range(100):
        want[None if i % 4 == 0 else i % 3] = want.get(None if i % 4 == 0 else i % 3, 0) + i
    want |= {7: None, 9: None}
    for bound in (vector_codes.BROADCAST_ROWS, 0):
        monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", bound)
        got = vector_codes.with_label_errors(rows, "label", "error", "label_error", "vec_id").collect()
        assert len(got) == 103 and all(r["label_error"] == want[r["label"]] for r in got)


def test_op11_equals_its_sql(spark, tmp_path):
    rows = _some(80, 64) + [(300 + i, [0.125] * 64, 1) for i in range(30)] + [(900, None, 1), (901, [None] * 64, 1)]
    _table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).toPandas().sort_values("vec_id")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got.values.tolist() == con.execute(vector_codes.OP11_SQL).df().sort_values("vec_id")[got.columns].values.tolist()


def _whitened(spark, rows, kind="float", components=16):
    df, length = vectors.usable(_table(spark, rows, kind))
    fit = whitening.fit_list(df)
    model = whitening.learn(fit, length, components)
    return whitening.whiten(df, model, length), model


def _brute_whitening(rows):
    """x, the distinct x, their mean, eigenvalues and vectors, by a dense eigenproblem."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows])
    u = np.unique(x, axis=0)
    away = (len(u) * u - u.sum(0)) / len(u)
    value, axes = np.linalg.eigh(away.T @ away / len(u))
    return x, u, value[::-1], axes[:, ::-1]


def test_whitening_equals_dense_eigenvectors(spark):
    rows = _some(400, 24) + [(1000 + i, [0.25] * 24, 1) for i in range(200)]
    out, model = _whitened(spark, rows + BAD)
    x, u, value, axes = _brute_whitening(rows)
    got = out.toPandas()
    assert len(got) == 16 * len(rows) and model.centre.n == len(u) == got["n"].iloc[0]
    z = ((len(u) * x - u.sum(0)) / len(u)) @ axes[:, :16] / np.sqrt(value[:16])
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]].to_numpy()
    assert np.abs(table * np.sign((table * z).sum(0)) - z).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id")
    exact = [sum((len(u) * int(c) - int(s)) ** 2 for c, s in zip(v, u.sum(0))) for v in x]
    assert [int(first.deviation[r[0]]) for r in rows] == exact
    shares = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(shares - value[:16] / value.sum()).max() < 1e-12 and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize("spectrum", ["flat", "steep", "low rank", "pairs"])
def test_lanczos_restarts_and_breakdowns(spectrum):
    d = 300
    draw = np.random.default_rng(5)
    q = np.linalg.qr(draw.normal(size=(d, d)))[0]
    value = {"flat": np.linspace(1, 2, d)[::-1], "steep": 2.0 ** -np.arange(d), "low rank": np.r_[np.arange(20, 0, -1.0), np.zeros(d - 20)], "pairs": np.repeat(np.arange(d // 2, 0, -1.0), 2)}[spectrum]
    v = (q * value) @ q.T
    passes = []
    found, axes, residual = whitening.leading(lambda b: passes.append(b.shape[1]) or v @ b, d, 16, block=8, most=48)
    assert np.abs(found - value[:16]).max() < 1e-10 * value[0] and residual < 1e-10 * value[0] and max(passes) <= 8
    assert np.abs(axes.T @ axes - np.eye(16)).max() < 1e-10 and np.abs(v @ axes - axes * found).max() < 1e-9 * value[0]


def test_lanczos_ends_early_when_residuals_are_small():
    d = 400
    value = np.r_[1e6 * 0.5 ** np.arange(16), np.full(d - 16, 1e-3)]
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))[0]
    columns = []
    found, _, _ = whitening.leading(lambda b: columns.append(b.shape[1]) or (q * value) @ (q.T @ b), d)
    assert sum(columns) < d / 3 and np.abs(found / value[:16] - 1).max() < 1e-6


def test_whitening_edges(spark):
    assert _whitened(spark, [])[0].count() == 0
    out, _ = _whitened(spark, [(None, [0.5, 0.25], 1), (1, [0.5, 0.25], 1)])
    rows = out.collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in rows)
    out, model = _whitened(spark, [(i, [float(i), 1.0, 2.0 * i], 1) for i in range(9)])
    found = {r["component"]: r["whitened"] for r in out.where("vec_id = 8").collect()}
    assert found[1] is not None and found[2] is None and found[3] is None and abs(model.explained[0] - 1) < 1e-12
    out, _ = _whitened(spark, [(i, [1e30 * i, float(i)], 1) for i in range(5)], "double")
    assert out.where("deviation is null").count() > 0 and out.count() == 10


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 52), 1 << 52), min_size=3, max_size=3), min_size=1, max_size=5), st.integers(1, 1 << 40))
def test_deviations_are_exact(rows, n):
    sums = [sum(r[j] for r in rows) for j in range(3)]
    centre = whitening.Centre(n, sums)
    want = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in rows]
    assert [int(d) for d in centre.deviations(np.array(rows, np.int64))] == want


def _brute_logit(net, text):
    """One text, chunk by chunk and run by run."""
    data = [*text.encode()]
    count = max(1, -(-(len(data) - quality_cnn.WIDTH) // quality_cnn.STRIDE))
    answers = []
    for c in range(count):
        own = data[c * quality_cnn.STRIDE : c * quality_cnn.STRIDE + quality_cnn.CHUNK]
        own += [quality_cnn.PAD] * (quality_cnn.CHUNK - len(own))
        runs = [np.concatenate([net["bytes"][b] for b in own[i : i + quality_cnn.WIDTH]]) @ net["filters"] for i in range(quality_cnn.CHUNK - quality_cnn.WIDTH + 1)]
        answers.append(np.maximum(np.max(runs, axis=0) + net["bias"], 0))
    pooled = np.concatenate([np.max(answers, axis=0), np.mean(answers, axis=0)])
    return float(np.tanh(pooled @ net["mix"] + net["shift"]) @ net["out"] + net["prior"][0])


def test_network_equals_brute_force():
    net = quality_cnn.start(0.7)
    net["bias"] = np.linspace(-1, 1, quality_cnn.FILTERS).astype(np.float32)
    draw = np.random.default_rng(2)
    texts = ["", "a", "12345678", "é ü 中 \x00", *("".join(chr(c) for c in draw.integers(32, 600, n)) for n in (150, 255, 264, 265, 700, 5000)), "end" * 90]
    got = quality_cnn.logits(net, *wordhash._raw(pa.array(texts)))
    assert np.abs(got - [_brute_logit(net, t) for t in texts]).max() < 1e-4
    piece, quality_cnn.PIECE = quality_cnn.PIECE, 3
    try:
        assert np.allclose(quality_cnn.logits(net, *wordhash._raw(pa.array(texts))), got, atol=1e-5)
    finally:
        quality_cnn.PIECE = piece


def test_gradient_equals_differences():
    net = quality_cnn.start(0.6)
    net["bias"] += 0.1  # off the kink where an answer to padding is 0
    texts, label = pa.array(["short", "x" * 700 + "tail of the text", "words " * 60, ""]), np.array([1, 0, 1, 0])
    data, offsets = wordhash._raw(texts)
    found = quality_cnn.gradient(net, data, offsets, label)

    def loss(net):
        z = quality_cnn.logits(net, data, offsets)
        return np.mean(np.log1p(np.exp(-np.where(label > 0, z, -z))))

    for k, g in found.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        sides = []
        for e in (1e-5, -1e-5):
            moved = {n: v.astype(np.float64) for n, v in net.items()}
            moved[k][at] += e
            sides.append(loss(moved))
        assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-3 * max(1e-2, abs(g[at]))
    assert not found["bytes"][quality_cnn.PAD].any()


def test_quality_is_learned_on_held_out_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_cnn, "ROUNDS", 5)
    draw = np.random.default_rng(4)
    word = lambda: "".join(draw.choice([*"abcdefghij"], draw.integers(2, 8)))
    kinds = [lambda w: " ".join(w), lambda w: " ".join(w[:3] * (len(w) // 3)), lambda w: " | ".join(w)]
    rows = [(i, kinds[i % 4 if i % 4 < 3 else 0]([word() for _ in range(draw.integers(30, 200))]), "s") for i in range(400)]
    frame = docs([*rows, (None, None, None), (1000, "", "s"), (1000, "", "s"), (1001, "late " + "!! X" * 200_000, "s")])
    labels = spark.createDataFrame([(i, int(i % 4 in (0, 3))) for i in range(400)] + [(3, 0), (5000, 1), (6, None)], "doc_id long, label int")
    net = quality_cnn.learn(frame, labels.where(~quality_cnn.held_out(F.col("doc_id"))))
    got = quality_cnn.score(frame, net).collect()
    assert len(got) == 404 and all(0 < r["__qc_score"] < 1 for r in got) and set(frame.columns) < set(got[0].asDict())
    right = [(r["__qc_score"] >= 0.5) == (r["doc_id"] % 4 in (0, 3)) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(right) > 50 and np.mean(right) > 0.95
    again = quality_cnn.learn(frame.repartition(7), labels.where(~quality_cnn.held_out(F.col("doc_id"))).repartition(3))
    assert all(np.array_equal(net[k], again[k]) for k in net)


def test_quality_without_labels(spark, docs):
    frame = docs(["a b c", None])
    for labels, share in (([], 0.5), ([(1, 1), (2, 1)], 2.5 / 3), ([(1, None), (9, 0)], 0.5)):
        net = quality_cnn.learn(frame, spark.createDataFrame(labels, "doc_id long, label int"))
        assert all(abs(r["__qc_score"] - share) < 1e-6 for r in quality_cnn.score(frame, net).collect())
    assert quality_cnn.score(docs([]), quality_cnn.start(0.5)).count() == 0

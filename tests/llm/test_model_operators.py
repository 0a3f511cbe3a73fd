import hashlib
import html
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agorafold.llm import chat_format, html_extract, html_pages, minhash, toxicity
from tests.llm.conftest import EDGES, words

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, extra string"


def _log(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENTS)


def test_chat_events_are_folded(spark):
    log = _log(spark, [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 3, "delta", None, "lo"), (1, 1, 1, "start", "assistant", ""), (1, 1, 2, "delta", None, "hel"),
        (1, 2, 0, "message", "user", "again"), (1, 2, 1, "edit", None, "again!"),
        (1, 3, 0, "start", "assistant", "bad"), (1, 3, 1, "regenerate", None, None), (1, 3, 2, "delta", None, "good"),
        (1, 4, 0, "message", "user", "gone"), (1, 4, 1, "delete", None, None),
    ])
    (row,) = chat_format.read_back(chat_format.format_chat(log)).collect()
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "again!"), ("assistant", "good")]
    assert row["n_turns"] == 4 and row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert row["loss_chars"] == 9 and row["loss_sha256"] == hashlib.sha256(b"hellogood").hexdigest()


def test_chat_round_trip_of_control_strings(spark):
    random.seed(1)
    texts = ["".join(random.choice(["<turn user>\n", "</turn>\n", "\\", "\\l", "<", ">", "é", "a", "\n"]) for _ in range(random.randint(0, 12))) for _ in range(200)]
    assert all(chat_format.unescape(chat_format.escape(t)) == t and "<" not in chat_format.escape(t) for t in texts)
    log = _log(spark, [(7, i, 0, "message", "assistant", t) for i, t in enumerate(texts)])
    (row,) = chat_format.read_back(chat_format.format_chat(log)).collect()
    assert row["loss_sha256"] == hashlib.sha256("".join(texts).encode()).hexdigest()


def test_chat_edges_and_parts(spark, monkeypatch):
    log = _log(spark, [(None, None, None, "message", None, None), (2, 0, 0, "message", "user", "a"), (2, 0, 0, "message", "user", "a"), (2, None, 0, "message", "", "")])
    rows = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(log)).collect()}
    assert rows[None]["n_turns"] == 1 and rows[2]["n_turns"] == 3
    assert chat_format.read_back(chat_format.format_chat(_log(spark, []))).count() == 0
    big = _log(spark, [(3, i, 0, "message", "assistant", "x" * 3_000_000) for i in range(4)])
    parts = chat_format.format_chat(big).collect()
    assert [p["part"] for p in parts] == [0, 1]
    (row,) = chat_format.read_back(chat_format.format_chat(big)).collect()
    assert row["loss_chars"] == 12_000_000 and row["n_turns"] == 4


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<nav>only menu</nav>", ""),
    ("<article><p>x &lt;y&gt; z &amp; q</p><p>cut off <b", "x <y> z & q\n\ncut off"),
    ("<article><header><h1>Title</h1></header><p>a b c</p><aside>ad text</aside><form><p>mail</p></form><p>d e f</article><footer>foot</footer>", "Title\n\na b c\n\nd e f"),
    ("<head><title>t</title><meta charset=u><p>para one two</p>", "para one two"),
    ("<main><p>a b c d</p></main><article class='comment'><p>I like this a lot really do</p></article>", "a b c d"),
    ("<div id=menu><a href=/>Home</a></div><div id=content><p>one  two\nthree</p><script>var a='</p>';</script>four</div><div class=cookie-banner>We use cookies</div>", "one two three\n\nfour"),
    (f"<article><p>start of it</p><div class='comments'><p>{'nice ' * 200}</p></div><p>the end</p></article>", "start of it\n\nthe end"),
])
def test_html_extraction(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<form method=post><div id=wrapper><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>One two three four five six seven.</p></article></div></form>", "Title here\n\nOne two three four five six seven."),
    ("<div class='page with-comments'><article><p>One two three four five six seven eight nine ten.</p></article><div class=comments><p>Nice one.</p></div></div>", "One two three four five six seven eight nine ten."),
    ("<div class='header-fixed wrapper'><main><p>One two three four five six seven eight nine ten.</p></main></div>", "One two three four five six seven eight nine ten."),
    ("<table><tr><td class=menu><a href=/a>Start</a><br><a href=/b>Archive</a></td><td><p>One two three four five six seven eight nine.</p></td></tr></table>", "One two three four five six seven eight nine."),
    ("<p>" + "one two three " * 9 + "end.</p><div class=advert>Buy this now today.</div><p>" + "four five six " * 9 + "end.</p>", "one two three " * 9 + "end.\n\n" + "four five six " * 9 + "end."),
])
def test_html_layouts(page, text):
    assert html_extract.extract(page) == text


PARAGRAPHS = "".join(f"<p>This is paragraph {i} with quite a few words in it, so that it reads like a sentence.</p>" for i in range(4))


@pytest.mark.parametrize("tag", ["<p title=don't>", '<p data-x=5">', "<p title='a\"b' id=q>", '<p title="x>y">', '<p title="open>', "<p title = it's class=lead>", "<p =x>"])
def test_html_attributes_are_read_as_browsers_do(tag):
    page = f"<article><h1>Head line</h1><p>One two three four five six seven eight.</p>{tag}Second paragraph with many words in it, isn't it so.</p><p>Third paragraph that isn't lost at all and has many words.</p></article>"
    assert html_extract.extract(page) == "Head line\n\nOne two three four five six seven eight.\n\nSecond paragraph with many words in it, isn't it so.\n\nThird paragraph that isn't lost at all and has many words."


def test_html_markup_of_unquoted_values_is_no_text():
    page = "<article><h1>T</h1><p>See <a href=/x title=Ann's>this link of mine</a> in a sentence of many words, it's long.</p></article>"
    assert html_extract.extract(page) == "T\n\nSee this link of mine in a sentence of many words, it's long."
    assert html_extract._attributes("a href=/x/ title='b c' hidden data-id=\"7\" X = y") == (("a", ""), ("href", "/x/"), ("title", "b c"), ("hidden", ""), ("data-id", "7"), ("x", "y"))
    assert html_extract._closes_itself("a=b /") and html_extract._closes_itself('x="a=b"/') and not html_extract._closes_itself("href=/x/")


@pytest.mark.parametrize("name", ["main-and-sidebar", "post form-layout", "main-comment-page", "ad-free article", "content-with-sidebar", "article login-required", "sidebar-layout"])
def test_html_frames_are_not_judged_by_names(name):
    text = html_extract.extract(f"<html><body><div class='{name}'><h1>Headline</h1>{PARAGRAPHS}</div></body></html>")
    assert text == "Headline\n\n" + "\n\n".join(re.findall("<p>(.*?)</p>", PARAGRAPHS))
    inner = html_extract.extract(f"<article><h1>Headline</h1>{PARAGRAPHS}</article><div class='{name.replace('main-', '').replace('post', '')} sidebar comments'><p>Nice one, thanks a lot for this.</p></div>")
    assert "Nice" not in inner and inner.count("\n\n") == 4


def test_scan_finds_the_best_of_all_stretches():
    random.seed(8)
    model = html_extract.Model({}, {"p": -0.5, "b": -2.0})
    for _ in range(300):
        tokens = [html_extract.Token(i, random.choice("pb") if random.random() < 0.5 else "x", i, html_extract.Place(frozenset(), in_main=random.random() < 0.3), False, 0) for i in range(random.randint(0, 14))]
        for t in tokens:
            t.is_text, t.n = t.value == "x", random.randint(0, 3) if t.value == "x" else 0
        scores = [random.choice([-1.5, -0.5, 0.5, 1.0, 2.0]) for _ in tokens]
        each = [s * t.n if t.is_text else model.tag(t.value) for t, s in zip(tokens, scores)]
        each = [-html_extract.PARTED * (t.n or 1) if e < 0 and t.place.in_main else e for e, t in zip(each, tokens)]
        best = max([0.0, *(sum(each[i:j]) for i in range(len(each)) for j in range(i + 1, len(each) + 1))])
        low, high = html_extract.stretch(tokens, scores, model)
        assert abs(sum(each[low:high]) - best) < 1e-9


def _main_words(page):
    return html.unescape(" ".join(re.sub("<[^>]*>", " ", piece) for piece, main in page if main)).split()


def test_html_held_out_pages():
    """Word precision and recall on pages with names that no learned page has, and what the scan adds."""
    model, pages = html_extract.learned(), html_pages.labelled(300, heldout=True)
    right, changed = {}, 0
    for scan in (True, False):
        both = found = wanted = 0
        for page in pages:
            own, truth = Counter(html_extract.extract("".join(p for p, _ in page), model, scan).split()), Counter(_main_words(page))
            both, found, wanted = both + sum((own & truth).values()), found + sum(own.values()), wanted + sum(truth.values())
        right[scan] = (both / found, both / wanted)
    for page in pages:
        whole = "".join(p for p, _ in page)
        changed += html_extract.extract(whole, model) != html_extract.extract(whole, model, scan=False)
    print(f"precision, recall: {right[True]}; without the scan {right[False]}; pages changed by it: {changed} of {len(pages)}")
    assert right[True][0] > 0.95 and right[True][1] > 0.97 and right[True][0] > right[False][0] and changed > 20


def test_html_time_is_linear():
    """Many open elements and closing tags that close nothing, deep nesting, long attributes."""
    for page in ("<i>" * 40_000 + "</b>" * 40_000, "<div class=a>" * 40_000 + "end", "<p " + "x" * 400_000 + ">a b c d", "<" * 100_000):
        began = time.perf_counter()
        html_extract.extract(page)
        assert time.perf_counter() - began < 5


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a b c</p>" * 20_000, "y"), (1, None, None, "x")], "page_id long, url string, html string, __hx string")
    rows = html_extract.main_text(pages).collect()
    assert len(rows) == 3 and rows[1]["__hx_text"].count("\n\n") == 19_999
    clash = spark.createDataFrame([(1, "<p>a b c</p>", "mine")], "page_id long, html string, text string")
    assert [(r["text"], r["__hx_text"]) for r in html_extract.main_text(clash).collect()] == [("mine", "a b c")]
    assert html_extract.main_text(pages.limit(0)).count() == 0


def _toxic_corpus(spark, docs, n=600):
    random.seed(11)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        own = [f"v{int(random.paretovariate(0.6)) % 3000}" for _ in range(random.randint(5, 120))]
        if bad:
            own.insert(random.randrange(len(own)), random.choice(["Nasty!", "vile", "(awful)"]))
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(bad)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, docs):
    table, labels = _toxic_corpus(spark, docs)
    machine = toxicity.learned(spark, table, labels)
    scored = toxicity.score(table, machine, name="score").withColumn("h", toxicity.held_out(F.col("doc_id")))
    rows = [(r["doc_id"] % 5 == 0, r["score"]) for r in scored.where("h").collect()]
    positive, negative = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert sum(a > b for a in positive for b in negative) / (len(positive) * len(negative)) > 0.97
    assert sum(s >= toxicity.REJECT for s in positive) > 0.9 * len(positive) and sum(s >= toxicity.REJECT for s in negative) < 0.03 * len(negative)


def test_toxicity_of_edges(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {round(r["__tx_score"], 6) for r in toxicity.score(docs(EDGES), toxicity.learn(docs(EDGES), empty)).collect()}
    assert scores == {0.5}
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (7, 0)], "doc_id long, toxic int")
    found = toxicity.score(docs(EDGES), toxicity.learn(docs(EDGES), labels)).collect()
    assert len(found) == len(EDGES) and all(0 <= r["__tx_score"] <= 1 for r in found)
    assert toxicity.score(docs([]), toxicity.learn(docs([]), labels)).count() == 0


def _auc(rows):
    positive, negative = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in positive for b in negative) / (len(positive) * len(negative))


def test_toxicity_of_pairs_alone(spark, docs):
    """Two terms, each as frequent in clean texts as in toxic ones; only both or none is toxic."""
    random.seed(23)
    rows, labels = [], []
    for i in range(1200):
        a, b = random.random() < 0.5, random.random() < 0.5
        own = [f"f{random.randint(0, 400)}" for _ in range(random.randint(5, 60))] + ["gnomes"] * a + ["spoon"] * b
        random.shuffle(own)
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(a == b)))
    machine = toxicity.learned(spark, docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert abs(machine.factors).max() > 0.3
    truth, found = dict(labels), {}
    for name, model in (("whole", machine), ("linear", machine.linear())):
        scored = toxicity.score(docs(rows), model).where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "__tx_score").collect()
        found[name] = _auc([(truth[i], s) for i, s in scored])
    assert found["whole"] > 0.97 and found["linear"] < 0.65, found


def test_toxicity_of_an_insult_beside_a_group(spark, docs):
    """The group's name says nothing alone, and the insult little; together they are toxic."""
    random.seed(29)
    rows, labels = [], []
    for i in range(1500):
        group, insult, other = random.random() < 0.3, random.random() < 0.3, random.random() < 0.05
        own = [f"f{random.randint(0, 400)}" for _ in range(random.randint(5, 60))] + ["martians"] * group + ["rats"] * insult + ["vile"] * other
        random.shuffle(own)
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(other or (group and insult))))
    machine = toxicity.learned(spark, docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.score(docs(rows), machine).where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "__tx_score").collect()
    wrong = sum((s >= toxicity.REJECT) != dict(labels)[i] for i, s in scored)
    assert wrong <= 0.02 * len(scored), wrong


def test_toxicity_keeps_clashing_names(spark, docs):
    table = docs(["a b", "c"]).withColumn("score", F.lit("mine"))
    machine = toxicity.learn(table, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(table, machine).collect()} == {"mine"}


def _sets(text):
    own = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def _classes(rows, least):
    sets = {i: _sets(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= least * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("least", [80, 85])
def test_near_duplicates_equal_brute_force(docs, least):
    random.seed(13)
    rows = []
    for base in range(12):
        own = [f"b{base}x{random.randint(0, 500)}" for _ in range(random.choice([3, 6, 7, 40, 150]))]
        for _ in range(random.randint(1, 14)):
            copy = list(own)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, 4])):
                copy[random.randrange(len(copy))] = f"z{random.randint(0, 9999)}"
            rows.append(" ".join(copy))
    chain = [f"c{i}" for i in range(120)]
    for _ in range(25):  # each like the one before, the last unlike the first
        chain[random.randrange(120)] = f"y{random.randint(0, 9999)}"
        rows.append(" ".join(chain))
    random.shuffle(rows)
    rows += ["", None, "one", "One", "a b c", "A  b\nc"]
    expected = _classes(list(enumerate(rows, 1)), least)
    found = {r["doc_id"]: (r["__nd_shingles"], r["__nd_class"]) for r in minhash.near_duplicates(docs(rows), least).collect()}
    assert found == expected


def test_near_duplicates_in_a_cloud(docs):
    """Many copies of one text, changed so much that few are alike: what isn't linked at first is still found."""
    random.seed(17)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(90):
        copy = list(base)
        for _ in range(random.choice([2, 4, 5, 6, 7])):
            copy[random.randrange(150)] = f"z{random.randint(0, 99_999)}"
        rows.append(" ".join(copy))
        if random.random() < 0.3:
            copy[random.randrange(150)] = f"z{random.randint(0, 99_999)}"
            rows.append(" ".join(copy))
    random.shuffle(rows)
    expected = _classes(list(enumerate(rows, 1)), 85)
    assert 3 < len({c for _, c in expected.values()}) < len(rows)
    assert {r["doc_id"]: (r["__nd_shingles"], r["__nd_class"]) for r in minhash.near_duplicates(docs(rows), 85).collect()} == expected


@pytest.mark.parametrize("least", [80, 85])
def test_near_duplicates_of_short_texts(docs, least):
    """Short texts with words appended or cut at the ends, of all sizes at which they just are alike."""
    random.seed(19)
    rows = []
    for base in range(400):
        own = [f"s{base}x{i}" for i in range(random.choice([8, 10, 11, 16, 20, 24, 34, 54]))]
        few = max(1, (100 - least) * (len(own) - 4) // 100)
        other = [*own, *(f"t{base}x{i}" for i in range(few))] if base % 2 else own[random.randint(0, few) :][: len(own) - few]
        rows += [" ".join(own), " ".join(other)]
    expected = _classes(list(enumerate(rows, 1)), least)
    assert len({c for _, c in expected.values()}) < 0.8 * len(rows)
    assert {r["doc_id"]: (r["__nd_shingles"], r["__nd_class"]) for r in minhash.near_duplicates(docs(rows), least).collect()} == expected


def test_near_duplicates_of_ten_and_eleven_words(docs):
    """300 pairs of which one text has a word more, at a random place of either end: each is found."""
    random.seed(37)
    rows = []
    for base in range(300):
        own = [f"p{base}x{i}" for i in range(11)]
        rows += [" ".join(own), " ".join(own[1:] if base % 2 else own[:-1])]
    found = {r["doc_id"]: r["__nd_class"] for r in minhash.near_duplicates(docs(rows)).collect()}
    assert all(found[2 * k + 2] == 2 * k + 1 for k in range(300))


def test_near_duplicates_without_broadcasts(docs, monkeypatch):
    random.seed(41)
    rows = []
    for base in range(20):
        own = [f"q{base}x{i}" for i in range(60)]
        for _ in range(3):
            copy = list(own)
            copy[random.randrange(60)] = "other"
            rows.append(" ".join(copy))
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    expected = _classes(list(enumerate(rows, 1)), 80)
    assert {r["doc_id"]: (r["__nd_shingles"], r["__nd_class"]) for r in minhash.near_duplicates(docs(rows), 80).collect()} == expected


def test_near_duplicates_of_small_and_large_sets(docs):
    """Pairs on both sides of the size from which registers are those of buckets."""
    rows = [words(n, 10_000 * k) for k, low in enumerate((1600, 1800, 1990, 2003, 2300)) for n in (low, low * 115 // 100)]
    expected = _classes(list(enumerate(rows, 1)), 85)
    assert len({c for _, c in expected.values()}) == 5
    assert {r["doc_id"]: (r["__nd_shingles"], r["__nd_class"]) for r in minhash.near_duplicates(docs(rows), 85).collect()} == expected


def test_near_duplicates_of_edges(docs):
    found = minhash.near_duplicates(docs(EDGES)).collect()
    assert len(found) == len(EDGES)
    classes = {r["doc_id"]: r["__nd_class"] for r in found}
    assert classes[5] == classes[6] == classes[8] == 5 and classes[1] == 1 and classes[2] == 2 and classes[None] is None
    kept = minhash.keep_one(docs(EDGES))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 9, 10, None} and kept.columns == docs([]).columns
    assert minhash.near_duplicates(docs([])).count() == 0


def test_collision_corrected_estimate():
    chances = [minhash.accidental(n, n) for n in (10, 1000, 100_000)]
    assert all(0 < c < 2 ** -minhash.MANTISSA for c in chances)


def test_pipeline_stages(spark, docs, tmp_path):
    table, labels = _toxic_corpus(spark, docs, 300)
    copies = docs([(10_000 + i, words(60, 5000), "t") for i in range(5)] + [(20_000, words(30, 7000), "t")] + [(r[0] and r[0] + 30_000, *r[1:]) for r in EDGES])
    everything = table.unionByName(copies)
    everything.write.parquet(f"file://{tmp_path}/in/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/in/labels.parquet")
    spark.createDataFrame([(1, words(30, 7000))], "item_id long, text string").write.parquet(f"file://{tmp_path}/in/benchmark.parquet")
    now, seen = spark.read.parquet(f"file://{tmp_path}/in/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, f"file://{tmp_path}/in").write.parquet(f"file://{tmp_path}/{k}")
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
        if k < 4:
            assert set(now.columns) == set(everything.columns)
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(toxic & set(seen["toxicity"])) < 0.1 * len(toxic) and len(set(range(300)) - toxic - set(seen["toxicity"])) < 5
    assert len([i for i in seen["near-duplicates"] if i and 10_000 <= i < 20_000]) == 1
    assert 20_000 in seen["near-duplicates"] and 20_000 not in seen["decontamination"]
    assert sorted(map(str, seen["mixing"])) == sorted(map(str, seen["sharding"]))
    run = corpus_pipeline.run(spark, f"file://{tmp_path}/in")
    assert sorted(str(r["doc_id"]) for r in run.collect()) == sorted(map(str, seen["sharding"]))


def test_pipeline_of_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

"""Near-duplicate documents by HyperMinHash, banding and verification.

A document's set: the distinct ``SHINGLE``-word shingles of its lower-cased
(A-Z) words, or its whole word sequence if it has fewer words.  Documents are
linked if 100 * |A and B| >= ``LEAST`` * |A or B|; a class is what links reach.

1. Sets are hashed to 64 bits a shingle.  Documents of one set form a group
   whose smallest id stands for it from here on, so copies cost nothing more.
2. HyperMinHash: the shingles are dealt to ``BUCKETS`` buckets by their hash,
   and a bucket's register keeps, of its least hash, the count of leading zeros
   and ``MANTISSA`` bits after them, 16 bits in all.  In a set of few shingles
   many buckets would be empty, and registers copied from others aren't
   independent; so sets of fewer than ``SMALL`` have registers of the least
   values of ``BUCKETS`` hash functions over all their shingles.  Larger sets
   that may be linked with a small one have registers of both kinds.
3. Banding: documents that agree in all ``BAND`` registers of a band share a
   key.  At similarity s two documents share none with probability
   (1 - s^BAND)^(BUCKETS / BAND), which is below 1e-8 at 0.85 and 1e-5 at 0.8,
   whatever their sizes: of two sets the smaller one's kind of registers counts.
   Sets too small to be linked with any unlike set have no keys.
4. Pairs of a key: not all of them.  First each document is paired with the
   smallest id it shares a key with, then with the first member of each of its
   keys that holds several classes.  What then remains in keys of several
   classes is paired where the rarest shingles of both sets meet, which no
   pair of similar sets can escape (prefix filter).  Documents of one class
   needn't be paired again, so a cloud of n near copies costs about n pairs,
   and no link between classes is lost.
5. Registers estimate the similarity of a pair, corrected for accidental
   agreement of compressed registers.  Pairs far below the threshold (by
   ``MARGIN``) are dropped; that this hits a similar pair has a chance below
   1e-16 (Chernoff's bound for BUCKETS registers).
6. Verification: what is left is linked if the full sets say so. The texts of
   documents with shared keys are set aside once (they are smaller than their
   sets); those of the pairs travel and are shingled again.
7. Classes: smallest reachable id by pointer jumping over the links.

Tables between the rounds are written to the shared folder.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing, and a document with a null doc_id neither links nor
is linked; its class is null.  Rows that share a doc_id are one document whose
set is that of the row with the most shingles, ties by hash.  An empty table
gives an empty result; other columns pass through, and internal ones start
with ``__nd_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.llm import common, wordhash

SHINGLE, LEAST = 5, 85
BUCKETS, BAND, MANTISSA = 240, 6, 10
MARGIN = 0.25
#: Sets of fewer shingles have registers of independent functions: in larger ones an empty bucket is rare.
SMALL = 2000
#: Rows of some 520 bytes that may be broadcast to pick texts (26 MB); more are joined by shuffling.
BROADCAST_ROWS = 50_000
_FIELDS = "n_shingles bigint, set_a bigint, set_b bigint, registers binary, bands array<bigint>"


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, in the order of text and hash."""
    w = wordhash.words(texts, lower=True)
    h = w.hashes()
    at, found = w.windows(h, SHINGLE)
    doc = w.doc[at]
    counts = w.counts
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for n in range(1, SHINGLE):
        own = few[counts[few] == n]
        if len(own):
            start = w.first[own]
            whole = np.zeros(len(own), np.uint64)
            for j, m in enumerate(wordhash._stream(2000 + n, n)):
                whole += h[start + j] * m
            doc, found = np.concatenate([doc, own]), np.concatenate([found, wordhash.mix(whole)])
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    first = np.append(True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1]))[: len(doc)]
    return doc[first], found[first]


def _packed(least: np.ndarray) -> np.ndarray:
    """16-bit registers of least values of 63 bits: leading zeros << MANTISSA | the bits after the leading one."""
    top = np.floor(np.log2(least.astype(np.float64))).astype(np.int64)
    top -= (np.uint64(1) << top.astype(np.uint64)) > least  # the logarithm may round up
    zeros = np.minimum(62 - top, (1 << (16 - MANTISSA)) - 1)
    shift = np.maximum(top - MANTISSA, 0).astype(np.uint64)
    return (zeros << MANTISSA | ((least >> shift).astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)


def _registers(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Registers of n texts, one a bucket."""
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    value = wordhash.mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1) | np.uint64(1)
    least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * BUCKETS + bucket, value)
    least = least.reshape(n, BUCKETS)
    full = least != np.iinfo(np.uint64).max
    # Of each bucket the next full one, going round.
    place = np.where(full, np.arange(BUCKETS), 2 * BUCKETS)
    following = np.minimum.accumulate(np.concatenate([place, place + BUCKETS], 1)[:, ::-1], 1)[:, ::-1][:, :BUCKETS] % BUCKETS
    return _packed(np.take_along_axis(least, following, 1))


def _independent(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Registers of n texts (none without shingles), one a hash function."""
    first = np.searchsorted(doc, np.arange(n))
    least = np.empty((n, BUCKETS), np.uint64)
    value = np.empty_like(h)
    for k, (m, again) in enumerate(zip(wordhash._stream(33, BUCKETS), wordhash._stream(34, BUCKETS), strict=True)):
        np.multiply(h, m, out=value)
        np.bitwise_xor(value, value >> np.uint64(32), out=value)
        np.multiply(value, again, out=value)
        least[:, k] = np.minimum.reduceat(value, first)
    return _packed(least >> np.uint64(1) | np.uint64(1))


def _signed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    salts = wordhash._stream(31, 2 * BUCKETS // BAND).reshape(2, -1)
    steps = wordhash._stream(32, BAND)
    for batch in wordhash.slices(batches, "text"):
        n = batch.num_rows
        doc, h = _shingles(batch.column("text"))
        size = np.bincount(doc, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(size)])
        sums = []
        for salt in (3, 5):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix(h ^ np.uint64(salt)))])
            sums.append(wordhash.mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64)))
        held, owner, keys = [b""] * n, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        # A small set's partners have up to 100 / least times its size: those have both kinds, the small sets' first.
        for kind, made, has in ((0, _independent, (size > 0) & (size * least < SMALL * 100)), (1, _registers, size >= SMALL)):
            where = np.flatnonzero(has)
            if not len(where):
                continue
            of = has[doc]
            registers = made((np.cumsum(has) - 1)[doc[of]], h[of], len(where))
            for i, row in zip(where.tolist(), registers, strict=True):
                held[i] += row.tobytes()
            bands = registers.reshape(-1, BAND, BUCKETS // BAND).transpose(0, 2, 1).astype(np.uint64)
            keys.append(wordhash.mix((wordhash.mix(bands + np.uint64(1)) * steps).sum(2, dtype=np.uint64) * salts[kind] + salts[kind]).ravel())
            owner.append(np.repeat(where, BUCKETS // BAND))
        owner, keys = np.concatenate(owner), np.concatenate(keys)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(owner, kind="stable")].view(np.int64)))
        columns = [
            *(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
            pa.array(held, pa.binary()), lists,
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in batch.schema.names if c != "text"), "n_shingles", "set_a", "set_b", "registers", "bands"])


def accidental(a: int, b: int) -> float:
    """Chance that registers of unlike minima agree: the same leading zeros and the same mantissa.

    For sets of a and b shingles, with minima near uniform on their scale: the
    sum over zeros of both minima's chances, over 2^MANTISSA.  A register is
    the least of all shingles of a small set, and else of a bucket's.
    """
    dealt = 1 if min(a, b) < SMALL else BUCKETS
    u, v = max(1.0, a / dealt), max(1.0, b / dealt)
    same = sum(((1 - 2.0 ** -(z + 1)) ** u - (1 - 2.0**-z) ** u) * ((1 - 2.0 ** -(z + 1)) ** v - (1 - 2.0**-z) ** v) for z in range(60))
    return same / (1 << MANTISSA)


def _likely(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose registers estimate a similarity not far below the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        small = (np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()) < SMALL).tolist()
        width = 2 * BUCKETS
        ours = lambda c: (r[:width] if s else r[-width:] for r, s in zip(batch.column(c).to_pylist(), small, strict=True))  # noqa: B023, E731
        left, right = (np.frombuffer(b"".join(ours(c)), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
        agree = (left == right).mean(1)
        chance = np.array([accidental(a, b) for a, b in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)])
        similar = (agree - chance) / (1 - chance)
        out = batch.filter(pa.array(similar >= least / 100 - MARGIN))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])


def _by_key(rows: DataFrame) -> DataFrame:
    """For a join by a shuffle, however few rows there are: rounds of small joins would else send some hundred broadcasts through the driver."""
    return rows.hint("merge")


def classes(links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, label): of every node of ``links`` (a, b) the smallest node it reaches.

    Each round takes the least label of a node and its neighbours, then the
    label of that label, until no label changes.
    """
    both = scratch.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = scratch.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(_by_key(labels.select(F.col("node").alias("v"), "label")), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(_by_key(near), F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("new"))
        # A label is a node: hook it to the least label seen by those who carry it, then jump.
        hooks = lower.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("least"))
        jumped = lower.join(_by_key(hooks), F.col("new") == F.col("root"), "left").select("node", "label", F.least("new", "least").alias("new"))
        own = hooks.select(F.col("root").alias("r2"), F.col("least").alias("own"))
        step = scratch.keep(jumped.join(_by_key(own), F.col("node") == F.col("r2"), "left").select("node", "label", F.least("new", "own").alias("new")))
        changed = step.where("new <> label").limit(1).count()
        scratch.drop(labels)
        labels = step.select("node", F.col("new").alias("label"))
        labels._scratch_path = step._scratch_path
        if not changed:
            return labels


def _linked(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in wordhash.slices(wordhash.slices(batches, "ta"), "tb"):
        n = batch.num_rows
        (da, ha), (db, hb) = _shingles(batch.column("ta")), _shingles(batch.column("tb"))
        doc, h = np.concatenate([da, db]), np.concatenate([ha, hb])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        common_ = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=n) if len(doc) else np.zeros(n, np.int64)
        either = np.bincount(da, minlength=n) + np.bincount(db, minlength=n) - common_
        out = batch.filter(pa.array((100 * common_ >= least * either) & (either > 0)))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])


def _verified(pairs: DataFrame, slim: DataFrame, least: int, scratch: common.Scratch) -> DataFrame:
    """The pairs (a < b) that are links: estimate by registers, then by the sets themselves."""
    left = slim.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = slim.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    sized = pairs.join(_by_key(left), "a").join(_by_key(right), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * least)
    likely = scratch.keep(sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lambda batches: _likely(batches, least), "a bigint, b bigint"))
    of = lambda x: slim.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    both = likely.join(_by_key(of("b")), "b").join(_by_key(of("a")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(lambda batches: _linked(batches, least), "a bigint, b bigint")


def _with_more(links: DataFrame, labels: DataFrame, pairs: DataFrame, slim: DataFrame, least: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Links and labels with the links among some pairs; both as they are if there are none."""
    more = scratch.keep(_verified(pairs, slim, least, scratch))
    if more.isEmpty():
        return links, labels
    links = scratch.keep(links.unionByName(more))
    return links, classes(links, scratch)


def _of_several_classes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label) of the keys whose members have more than one label."""
    labelled = members.join(_by_key(labels), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return labelled.join(_by_key(mixed), F.col("key") == F.col("k"), "left_semi").select("key", "id", "label")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, shingles) of the texts."""
    for batch in wordhash.slices(batches, "text"):
        doc, h = _shingles(batch.column("text"))
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists], names=["id", "label", "shingles"])


def _prefix_pairs(left: DataFrame, slim: DataFrame, least: int, scratch: common.Scratch) -> DataFrame:
    """Pairs (a < b) of unlike labels that can be alike at all, of the documents ``left`` (id, label).

    Sets of m and n shingles are alike only if they share o = least * (m + n) / (100 + least)
    of them, rounded up; so, with all shingles in one order, they share one of
    the first m - o + 1 of the one and n - o + 1 of the other.  The rarest
    shingles come first, so few sets meet, also within one cloud of copies.
    """
    texts = slim.select(F.col("id").alias("i"), "text").join(left, F.col("i") == F.col("id")).select("id", "label", "text")
    listed = texts.mapInArrow(_listed, "id bigint, label bigint, shingles array<bigint>")
    each = scratch.keep(listed.select("id", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("h")))
    often = each.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("id").orderBy(F.coalesce("often", F.lit(1).cast("long")), "h")
    ranked = each.join(_by_key(often), F.col("h") == F.col("g"), "left").withColumn("at", F.row_number().over(order))  # a document's own shingles
    # The shortest partner has least% of a set's size, which makes the longest prefix.
    some = scratch.keep(ranked.where(f"often > 1 and at <= n - ceil({least} * n / 100.0D) + 1").select("id", "label", "n", "h", "at"))
    x, y = some.alias("x"), some.alias("y")
    shared = f"({least} * (x.n + y.n) + {99 + least}) div {100 + least}"
    on = f"x.h = y.h and x.id < y.id and x.label <> y.label and x.at <= x.n - {shared} + 1 and y.at <= y.n - {shared} + 1"
    return x.join(y, F.expr(on)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, __nd_shingles, __nd_class): one row per row of ``docs`` with its set's size and its class.

    docs: doc_id (whole numbers) and text.  least: the similarity, in hundredths, from which documents are linked.
    """
    scratch = common.Scratch(docs.sparkSession, "minhash")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    tied = keyed.withColumn("text_key", F.xxhash64("text"))
    signed = scratch.keep(tied.select("id", "text_key", "text").mapInArrow(lambda batches: _signed(batches, least), f"id bigint, text_key bigint, {_FIELDS}"))
    known = signed.where("n_shingles > 0 and id is not null").groupBy("id").agg(F.max(F.struct("n_shingles", "set_a", "set_b", "text_key")).alias("s")).select("id", "s.*")
    known = scratch.keep(known)
    groups = scratch.keep(known.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep")))
    reps = groups.join(known.select(F.col("id").alias("rep"), "text_key"), "rep").select("rep", F.col("text_key").alias("rep_key"))
    same = (F.col("id") == F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
    sets = signed.join(reps, same, "left_semi").dropDuplicates(["id"])

    # Keys that at least two groups share.
    # Unlike sets that are linked have at least least / (100 - least) shingles in common.
    keys = sets.where(F.col("n_shingles") * (100 - least) >= least).select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    members = scratch.keep(keys.join(_by_key(shared), F.col("key") == F.col("k"), "left_semi").distinct())
    slim = sets.join(members.select(F.col("id").alias("m")).distinct(), F.col("id") == F.col("m"), "left_semi")
    slim = scratch.keep(slim.select("id", "text_key", "n_shingles", "registers"))
    wanted = slim.select(F.col("id").alias("i"), F.col("text_key").alias("k"), "n_shingles", "registers")
    wanted = F.broadcast(wanted) if slim.count() <= BROADCAST_ROWS else wanted
    with_text = tied.join(wanted, (F.col("id") == F.col("i")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["id"])
    slim = scratch.keep(with_text.select("id", "n_shingles", "registers", "text"))

    # First each document with the smallest of its keys' first members, one pair a document.
    first = members.groupBy("key").agg(F.min("id").alias("a"))
    pairs = members.join(_by_key(first), "key").where("id > a").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.keep(_verified(pairs, slim, least, scratch))
    labels = classes(links, scratch)
    # Then with the first member of each key that still has several classes.
    open_keys = scratch.keep(_of_several_classes(members, labels))
    pivots = open_keys.groupBy("key").agg(F.min(F.struct("id", "label")).alias("p")).select("key", F.col("p.id").alias("a"), F.col("p.label").alias("la"))
    pairs = open_keys.join(_by_key(pivots), "key").where("label <> la").select("a", F.col("id").alias("b")).distinct()
    links, labels = _with_more(links, labels, pairs, slim, least, scratch)
    # Then all that can be alike among what is left.
    left = scratch.keep(_of_several_classes(members, labels).select("id", "label").distinct())
    pairs = _prefix_pairs(left, slim, least, scratch)
    links, labels = _with_more(links, labels, pairs, slim, least, scratch)

    of_group = groups.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("n_shingles").alias("n"), F.col("set_a").alias("x"), F.col("set_b").alias("y"), F.coalesce("label", "rep").alias("class")
    )
    on = (F.col("n_shingles") == F.col("n")) & (F.col("set_a") == F.col("x")) & (F.col("set_b") == F.col("y"))
    by_id = known.join(of_group, on).select(F.col("id").alias("__i"), "class")
    out = signed.select("id", "n_shingles").join(by_id, F.col("id") == F.col("__i"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n_shingles").alias("__nd_shingles"), F.coalesce("class", "id").alias("__nd_class"))


def keep_one(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id, and all that have no class."""
    found = near_duplicates(docs.select("doc_id", "text"), least)
    gone = found.where("doc_id <> __nd_class").select(F.col("doc_id").alias("__nd_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__nd_id"), "left_anti")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__nd_shingles").alias("n_shingles"), F.col("__nd_class").alias("component_id"), (F.col("doc_id") == F.col("__nd_class")).alias("kept"))


OP9_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {LEAST} * (na.n + nb.n - common)
), r(a, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a
), c AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

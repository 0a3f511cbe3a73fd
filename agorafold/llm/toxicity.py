"""Toxicity by a factorization machine over hashed terms.

    logit(score) = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

x_i is 1 if a text has a term of bucket i.  The factors v let a pair of terms
(an insult beside a group's name) count more, or less, than the two weights
together, which a linear model can't.  A score costs time in proportion to the
text's distinct terms.

Learning takes a bounded sample of labelled documents, ``MAX_ROWS`` at most, in
the order of a hash of their ids.  Its texts stay in Spark:

1. Near copies are set aside: of texts that share a band of least hashes, those
   like the first one; else they would look like independent witnesses.
2. Every bucket's documents and toxic documents are counted.  A bucket is
   evident if its toxic share differs from the sample's by more than chance
   among so many buckets (Chernoff's bound under ``CHANCE`` / buckets).
3. Pairs: a pair of buckets is evident if its documents are toxic more often
   than the sample and than those of either bucket alone, again by more than
   chance among all pairs.  So terms without any evidence of their own (as
   frequent in clean as in toxic texts) are found by their partners.  Only
   buckets in enough toxic documents can belong to such a pair; the pairs of
   these are counted block by block as matrix products in Spark tasks, over
   the toxic documents and ``CONTROLS`` times as many others.
4. Weights and factors of the evident buckets and of the members of evident
   pairs are fitted on the driver, which receives the numbers of these buckets
   only: the maximum a posteriori under normal priors of ``SPREAD_W`` and
   ``SPREAD_V``, by Adam steps over the whole sample.

Scoring reads every text whole, in Spark tasks.

Terms are runs of ASCII letters (lower-cased) and digits and of non-ASCII
characters, and the first ``PREFIXES`` bytes of longer ones, so that other
forms of a word are known by its stem.

Defined results: a null or empty text has no terms and scores the bias; rows
that repeat a doc_id are each scored, and count once in learning; a label
that is null isn't learned from, and of contradicting labels the larger
counts; without labels every score is 0.5; an empty table gives an empty
result; other columns pass through, and the score's column is ``__tx_score``
unless another name is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from agorafold.llm import common, wordhash

BITS, FACTORS = 22, 4
PREFIXES = (5, 7)
#: Labelled documents that are learned from, at most.
MAX_ROWS = 12_000
#: Documents without the label for each with it, at most, where pairs are counted.
CONTROLS = 4
#: Least hashes by which near copies are told (bands of rows), and the share of them that agree.
BANDS, BAND_ROWS, LIKE = 8, 3, 0.5
CHANCE = 0.05
STEPS, RATE, SPREAD_W, SPREAD_V = 400, 0.05, 8.0, 1.0
#: Buckets of a block whose pairs are counted at once.
BLOCK = 1024
REJECT = 0.7


@dataclass
class Machine:
    """buckets: sorted, those with parameters; weights and factors: of these."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from (text, place in ``buckets``) pairs without repeats."""
        out = np.full(n, self.bias)
        out += np.bincount(doc, self.weights[slot], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f]
            out += 0.5 * (np.bincount(doc, v, minlength=n) ** 2 - np.bincount(doc, v * v, minlength=n))
        return out

    def linear(self) -> Machine:
        """The same without interactions."""
        return replace(self, factors=np.zeros_like(self.factors))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _divergence(share: np.ndarray, base: np.ndarray | float) -> np.ndarray:
    """Kullback and Leibler's, of shares from base shares."""
    share, base = (np.clip(np.asarray(x, float), 1e-12, 1 - 1e-12) for x in (share, base))
    return share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))


def fit(doc: np.ndarray, slot: np.ndarray, label: np.ndarray, buckets: np.ndarray, seed: int = 7) -> Machine:
    """Parameters of ``buckets`` from texts' (text, place in ``buckets``) pairs without repeats."""
    n, k = len(label), len(buckets)
    prior = (label.sum() + 0.5) / (n + 1)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(k), np.random.default_rng(seed).normal(0, 0.1, (k, FACTORS))]
    spread = [np.inf, SPREAD_W, SPREAD_V]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    model = lambda: Machine(float(params[0][0]), buckets, params[1], params[2])
    for t in range(1, STEPS + 1 if k else 1):
        error = _sigmoid(model().logits(doc, slot, n)) - label
        each = error[doc]
        v = params[2][slot]
        total = np.stack([np.bincount(doc, v[:, f], minlength=n) for f in range(FACTORS)], 1)
        of_v = np.stack([np.bincount(slot, each * (total[doc, f] - v[:, f]), minlength=k) for f in range(FACTORS)], 1)
        for i, g in enumerate((np.array([error.sum()]), np.bincount(slot, each, minlength=k), of_v)):
            g = g + params[i] / spread[i] ** 2
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return model()


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each term of each text, with repeats."""
    w = wordhash.words(texts, lower=True, rule=wordhash.TERM)
    docs, found = [w.doc], [w.hashes()]
    for k in PREFIXES:
        longer = np.flatnonzero(w.end - w.start > k)
        docs.append(w.doc[longer])
        found.append(wordhash.mix(wordhash.span_hashes(w.data, w.start[longer], w.start[longer] + k) + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _once(doc: np.ndarray, number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    pairs = np.unique(doc.astype(np.int64) << bits | number)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = wordhash._stream(7, BANDS * BAND_ROWS)
    for batch in wordhash.slices(batches, "text"):
        n = batch.num_rows
        doc, bucket = _once(*_terms(batch.column("text")), BITS)
        filled, first = np.unique(doc, return_index=True)
        numbers = bucket.astype(np.uint64) + np.uint64(1)
        least = np.stack([np.minimum.reduceat(wordhash.mix(numbers * s), first) for s in salts], 1) if len(doc) else np.zeros((0, len(salts)), np.uint64)
        columns = [batch.column(c) for c in ("doc_id", "toxic", "tie")]
        yield pa.RecordBatch.from_arrays([*columns, _lists(np.repeat(filled, len(salts)), least.view(np.int64).ravel(), n), _lists(doc, bucket.astype(np.int32), n)], names=["doc_id", "toxic", "tie", "least", "buckets"])


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, scratch: common.Scratch) -> DataFrame:
    """(doc_id, toxic, buckets) of the texts that are learned from, without near copies."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "__id")
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))  # max_rows rows
    rows = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.xxhash64("text").alias("tie"), "text")
    featured = rows.mapInArrow(_featured, "doc_id bigint, toxic int, tie bigint, least array<bigint>, buckets array<int>")
    texts = scratch.keep(featured.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "least", "buckets"), "tie").alias("r")).select("doc_id", "r.*"))
    bands = ", ".join(f"xxhash64({b}, {', '.join(f'least[{b * BAND_ROWS + k}]' for k in range(BAND_ROWS))})" for b in range(BANDS))
    keys = texts.where("size(least) > 0").select("doc_id", "least", F.explode(F.expr(f"array({bands})")).alias("band"))
    first = keys.groupBy("band").agg(F.min(F.struct("doc_id", "least")).alias("f"), F.count("*").alias("n")).where("n > 1")
    alike = F.expr("aggregate(zip_with(least, f.least, (x, y) -> if(x = y, 1, 0)), 0, (a, x) -> a + x)") >= LIKE * BANDS * BAND_ROWS
    gone = keys.join(first, "band").where((F.col("doc_id") > F.col("f.doc_id")) & alike).select(F.col("doc_id").alias("g")).distinct()
    return scratch.keep(texts.join(F.broadcast(gone), F.col("doc_id") == F.col("g"), "left_anti").select("doc_id", "toxic", "buckets"))  # max_rows ids


def _placed(rows: DataFrame, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in ``buckets``) pairs and the texts' labels; other buckets stay behind."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            own = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(buckets, own), max(0, len(buckets) - 1))
            has = buckets[at] == own if len(buckets) else np.zeros(len(own), bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), _lists(doc[has], at[has].astype(np.int32), batch.num_rows)], names=["doc_id", "toxic", "slots"])

    found = rows.mapInArrow(placed, "doc_id bigint, toxic int, slots array<int>").toArrow().sort_by("doc_id")
    slots = found.column("slots")
    size = np.concatenate([np.zeros(0, np.int32), *(c.value_lengths().to_numpy() for c in slots.chunks)])
    flat = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in slots.chunks)])
    return np.repeat(np.arange(len(size), dtype=np.int32), size), flat, found.column("toxic").to_numpy().astype(float)


def _pairs(shared, n_blocks: int, bound: float, need: int):
    """Per block pair, of each bucket the evident pair with the most evidence."""

    def block(k: int, rows: np.ndarray) -> np.ndarray:
        ends, docs, _ = shared.value
        low, high = k * BLOCK, min((k + 1) * BLOCK, len(ends) - 1)
        out = np.zeros((len(rows), high - low), np.float32)
        row = docs[ends[low] : ends[high]]
        out[row, np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))] = 1
        return out

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = shared.value[2]
        toxic = label > 0
        for pair in (x for batch in batches for x in batch.column(0).to_pylist()):
            i, j = divmod(pair, n_blocks)
            x, y = block(i, label), block(j, label)
            bad = x[toxic].T @ y[toxic]
            at = np.nonzero(bad >= need)
            if not len(at[0]):
                continue
            seen = (x.T @ y)[at]
            bad = bad[at]
            own = lambda z: z[toxic].sum(0) / np.maximum(z.sum(0), 1)
            base = np.maximum(np.maximum(own(x)[at[0]], own(y)[at[1]]), toxic.mean())
            evidence = np.where(bad / seen > base, seen * _divergence(bad / seen, base), 0)
            ok = evidence > bound
            a, b, e = at[0][ok] + i * BLOCK, at[1][ok] + j * BLOCK, evidence[ok]
            a, b, e = a[a != b], b[a != b], e[a != b]
            order = np.argsort(-e, kind="stable")
            best = np.unique(np.concatenate([order[np.unique(z[order], return_index=True)[1]] for z in (a, b)])) if len(a) else order
            yield pa.RecordBatch.from_arrays([pa.array(a[best].astype(np.int32)), pa.array(b[best].astype(np.int32)), pa.array(e[best].astype(float))], names=["a", "b", "evidence"])

    return counted


def evident_pairs(rows: DataFrame, counts: DataFrame, positives: int) -> list[tuple[int, int]]:
    """Pairs of buckets that are toxic together beyond the share of either: of each bucket the most evident."""
    spark = rows.sparkSession
    cases = rows.where("toxic = 1").unionByName(rows.where("toxic = 0").orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(CONTROLS * positives))
    n = cases.count()
    if not positives or n == positives:
        return []
    # A pair seen in toxic documents only has evidence seen * log(1 / share of them): fewer can't be evident.
    least = max(1, int(np.log(1 / CHANCE) / np.log(n / positives)))
    supported = counts.where(F.col("toxic") >= least).agg(F.count("*")).first()[0]
    bound = float(np.log(max(1.0, supported * (supported - 1) / 2) / CHANCE))
    need = int(np.ceil(bound / np.log(n / positives)))
    buckets = np.sort(np.array([r[0] for r in counts.where(F.col("toxic") >= need).select("bucket").collect()], np.int32))  # in ``need`` of max_rows texts each
    doc, slot, label = _placed(cases, buckets)
    order = np.argsort(slot, kind="stable")
    ends = np.searchsorted(slot[order], np.arange(len(buckets) + 1))
    shared = spark.sparkContext.broadcast((ends, doc[order], label.astype(np.float32)))
    n_blocks = -(-len(buckets) // BLOCK)
    ids = [(i * n_blocks + j,) for i in range(n_blocks) for j in range(i, n_blocks)]
    if not ids:
        return []
    work = spark.createDataFrame(ids, "pair long").repartition(min(len(ids), 2 * spark.sparkContext.defaultParallelism))
    found = work.mapInArrow(_pairs(shared, n_blocks, bound, need), "a int, b int, evidence double").toArrow()  # two rows a bucket and block
    shared.destroy()
    best: dict[int, tuple[float, int, int]] = {}
    for a, b, e in zip(*(found.column(c).to_pylist() for c in ("a", "b", "evidence")), strict=True):
        for x in (a, b):
            best[x] = max(best.get(x, (0.0, 0, 0)), (e, a, b))
    return sorted({(int(buckets[a]), int(buckets[b])) for _, a, b in best.values()})


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """A machine fitted to at most ``max_rows`` labelled documents."""
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    rows = _sample(docs, labels, max_rows, scratch)
    counts = scratch.keep(rows.select(F.explode("buckets").alias("bucket"), "toxic").groupBy("bucket").agg(F.count("*").alias("seen"), F.sum("toxic").alias("toxic")))
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (positives + 0.5) / (n + 1)
    share = F.greatest(F.lit(1e-12), F.least(F.col("toxic") / F.col("seen"), F.lit(1 - 1e-12)))
    apart = share * F.log(share / prior) + (1 - share) * F.log((1 - share) / (1 - prior))
    bound = float(np.log(max(1, counts.count()) / CHANCE))
    chosen = {r[0] for r in counts.where(F.col("seen") * apart > bound).select("bucket").collect()}  # of max_rows texts
    chosen.update(b for pair in evident_pairs(rows, counts, positives) for b in pair)
    buckets = np.array(sorted(chosen), np.int32)
    return fit(*_placed(rows, buckets), buckets)


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "__tx_score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    column = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[machine.buckets] = np.arange(len(machine.buckets))
        for batch in wordhash.slices(batches, text):
            doc, bucket = _terms(batch.column(column))
            slot = place[bucket]
            doc, slot = _once(doc[slot >= 0], slot[slot >= 0].astype(np.int64), BITS)
            found = pa.array(_sigmoid(machine.logits(doc, slot, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of the labelled rows outside the held-out fold."""
    return learn(docs, labels.where(~held_out(F.col("doc_id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learned(spark, docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__tx_score").alias("score"), (F.col("__tx_score") >= REJECT).cast("int").alias("predicted"))

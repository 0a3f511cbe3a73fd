"""Text quality by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes, one every
``STRIDE`` bytes, so that neighbours overlap by a filter's width: every run of
``WIDTH`` bytes of the whole text lies in a chunk, and only the last chunk is
padded.  Then

1. every byte becomes ``DEPTH`` learned numbers (padding: zeros);
2. ``FILTERS`` learned filters of ``WIDTH`` bytes run over each chunk, and each
   chunk keeps a filter's largest answer (max-pooling), cut off at 0;
3. a text keeps, of each filter, the largest and the mean answer of its
   chunks; one hidden layer turns these into a logit, and that into one
   probability.

The mean over chunks sees what fills a text (symbols, capitals, few distinct
patterns where words or lines repeat), the largest what occurs anywhere.  A
text of any length is worked on ``PIECE`` chunks at a time.

Learning takes a bounded sample of labelled documents, ``MAX_ROWS`` at most, in
the order of a hash of their ids, and their whole texts.  The sample is dealt
into at most ``SHARDS`` groups of at least ``SHARD_ROWS``.  In every round each
group's task goes on from the same parameters with ``STEPS`` Adam steps over
minibatches of its own texts; the driver averages what the tasks return, some
thousands of numbers each.  All draws are seeded and texts are taken in the
order of their ids, so reruns learn the same network.

Defined results: a null or empty text is one chunk of padding; rows that repeat
a doc_id are each scored, and count once in learning (with the least text of a
hash order); a null label isn't learned from, and of contradicting labels the
larger counts; without labels, or with one kind only, every score is their
smoothed share (0.5 without any); an empty table gives an empty result; other
columns pass through, and the score's column is ``__qc_score`` unless another
name is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from agorafold.llm import common, wordhash

DEPTH, WIDTH, FILTERS, HIDDEN = 4, 8, 32, 16
STRIDE = 256
CHUNK = STRIDE + WIDTH
PAD = 256
#: Chunks that are worked on at once.
PIECE = 256
#: Labelled documents that are learned from, at most; groups they are dealt into, and the fewest rows of a group.
MAX_ROWS, SHARDS, SHARD_ROWS = 4096, 4, 256
ROUNDS, STEPS, BATCH, RATE, DECAY = 10, 80, 16, 0.01, 1e-4
KEEP = 0.3

Network = dict[str, np.ndarray]


def start(share: float, seed: int = 12) -> Network:
    """A network before learning, whose scores are near ``share``."""
    draw = np.random.default_rng(seed)
    made = {
        "bytes": draw.normal(0, 0.5, (PAD + 1, DEPTH)), "filters": draw.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)), "bias": np.zeros(FILTERS),
        "mix": draw.normal(0, (1 / (2 * FILTERS)) ** 0.5, (2 * FILTERS, HIDDEN)), "shift": np.zeros(HIDDEN), "out": draw.normal(0, 0.1, HIDDEN), "prior": np.array([np.log(share / (1 - share))]),
    }
    made["bytes"][PAD] = 0
    return {k: v.astype(np.float32) for k, v in made.items()}


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes in it, text) of each chunk of texts that lie one after another."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - WIDTH) // STRIDE))
    text = np.repeat(np.arange(len(size)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return offsets[:-1][text] + first, np.minimum(CHUNK, size[text] - first), text


def _numbers(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) byte values, PAD where a chunk has ended."""
    at = np.arange(CHUNK)
    inside = at < size[:, None]
    return np.where(inside, data[np.where(inside, first[:, None] + at, 0)].astype(np.int16) if len(data) else np.int16(0), np.int16(PAD))


def answers(net: Network, numbers: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(chunks, FILTERS): the largest answer of each filter in each chunk, before the cut; and where it starts.

    Runs that start WIDTH apart lie side by side in memory, so WIDTH plain
    matrix products over the same numbers are the whole convolution.
    """
    m, across = len(numbers), CHUNK // WIDTH
    flat = np.concatenate([net["bytes"][numbers].ravel(), np.zeros(WIDTH * DEPTH, np.float32)])
    best = np.full((m, FILTERS), -np.inf, np.float32)
    where = np.zeros((m, FILTERS), np.int64) if places else None
    for r in range(WIDTH):
        runs = flat[r * DEPTH : r * DEPTH + m * CHUNK * DEPTH].reshape(-1, WIDTH * DEPTH)
        found = (runs @ net["filters"]).reshape(m, across, FILTERS)[:, : across - (r > 0)]  # the last run would reach into the next chunk
        if places:
            at = found.argmax(axis=1)
            top = np.take_along_axis(found, at[:, None], axis=1)[:, 0]
            where = np.where(top > best, at * WIDTH + r, where)
        else:
            top = found.max(axis=1)
        best = np.maximum(best, top)
    return best + net["bias"], where


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(text, answer cut at 0, place) of every chunk."""
    first, size, text = chunks(offsets)
    parts = [answers(net, _numbers(data, first[i : i + PIECE], size[i : i + PIECE]), places) for i in range(0, len(text), PIECE)]
    where = np.concatenate([p[1] for p in parts]) if places and parts else None
    return text, np.maximum(np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, FILTERS), np.float32), 0), where


def _texts(text: np.ndarray, of_chunks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2 * FILTERS): largest and mean answers; and how many chunks each text has."""
    begin = np.searchsorted(text, np.arange(n))
    count = np.bincount(text, minlength=n)
    return np.hstack([np.maximum.reduceat(of_chunks, begin, axis=0), np.add.reduceat(of_chunks, begin, axis=0) / count[:, None]]), count


def _head(net: Network, of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(of_texts @ net["mix"] + net["shift"])
    return hidden, hidden @ net["out"] + net["prior"][0]


def logits(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number a text."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0)
    text, of_chunks, _ = pooled(net, data, offsets)
    return _head(net, _texts(text, of_chunks, n)[0])[1].astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def gradient(net: Network, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> Network:
    """Of the mean logistic loss of the texts."""
    n = len(label)
    text, of_chunks, where = pooled(net, data, offsets, places=True)
    of_texts, count = _texts(text, of_chunks, n)
    hidden, logit = _head(net, of_texts)
    error = ((sigmoid(logit) - label) / n).astype(np.float32)
    into = error[:, None] * net["out"] * (1 - hidden**2)
    out = {"prior": error.sum(keepdims=True), "out": hidden.T @ error, "mix": of_texts.T @ into, "shift": into.sum(axis=0)}
    back = into @ net["mix"].T
    # The mean reaches every chunk, the largest answer the first chunk that has it.
    each = (back[:, FILTERS:] / count[:, None])[text]
    is_top = of_chunks == of_texts[:, :FILTERS][text]
    seen = np.cumsum(is_top, axis=0)
    begin = np.searchsorted(text, np.arange(n))
    is_top &= seen - (seen[begin] - is_top[begin])[text] == 1
    each = np.where(of_chunks > 0, each + np.where(is_top, back[:, :FILTERS][text], 0), 0).astype(np.float32)
    out |= {"bias": each.sum(axis=0), "filters": np.zeros_like(net["filters"]), "bytes": np.zeros_like(net["bytes"])}
    first, size, _ = chunks(offsets)
    steps = np.arange(WIDTH)
    taps = net["filters"].T.reshape(FILTERS, WIDTH, DEPTH)
    for i in range(0, len(text), PIECE):
        own, g = slice(i, i + PIECE), each[i : i + PIECE]
        numbers = _numbers(data, first[own], size[own])
        runs = np.take_along_axis(numbers, (where[own][:, :, None] + steps).reshape(len(g), -1), axis=1).reshape(len(g), FILTERS, WIDTH)
        out["filters"] += np.einsum("mf,mfk->kf", g, net["bytes"][runs].reshape(len(g), FILTERS, -1))
        flat = runs.ravel()
        for d in range(DEPTH):
            out["bytes"][:, d] += np.bincount(flat, (g[:, :, None] * taps[:, :, d]).ravel(), minlength=PAD + 1)
    out["bytes"][PAD] = 0
    return out


@dataclass
class State:
    """A network in learning: its numbers, Adam's two moments, and the steps so far."""

    net: Network
    first: Network
    second: Network
    taken: int = 0

    def pack(self) -> bytes:
        return np.concatenate([part[k].ravel() for part in (self.net, self.first, self.second) for k in sorted(self.net)]).astype(np.float32).tobytes()

    def unpack(self, numbers: np.ndarray, taken: int) -> State:
        """The state of these numbers, in the shapes of this one."""
        parts, at = [{}, {}, {}], 0
        for part in parts:
            for k in sorted(self.net):
                size = self.net[k].size
                part[k] = numbers[at : at + size].reshape(self.net[k].shape).astype(np.float32)
                at += size
        return State(*parts, taken)

    def step(self, found: Network, rate: float) -> None:
        self.taken += 1
        for k, g in found.items():
            g = g + DECAY * self.net[k]
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            toward = (self.first[k] / (1 - 0.9**self.taken)) / (np.sqrt(self.second[k] / (1 - 0.99**self.taken)) + 1e-8)
            self.net[k] = (self.net[k] - rate * toward).astype(np.float32)


def fit(state: State, texts: pa.Array, label: np.ndarray, steps: int, seed: tuple[int, ...]) -> State:
    """The state after ``steps`` minibatches of the texts."""
    draw, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for _ in range(steps):
        if len(order) < min(BATCH, len(label)):
            order = np.append(order, draw.permutation(len(label)))
        own, order = order[:BATCH], order[BATCH:]
        data, offsets = wordhash._raw(texts.take(pa.array(own)))
        state.step(gradient(state.net, data, offsets, label[own]), RATE)
    return state


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, label, text): the texts that are learned from, whole."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "__id")
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))  # max_rows rows
    return joined.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """A network fitted to at most ``max_rows`` documents. labels: doc_id, label."""
    rows = common.Scratch(docs.sparkSession, "quality-cnn").keep(_sample(docs, labels, max_rows))
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    net = start((good + 0.5) / (n + 1))
    if good in (0, n):
        return net | {"out": np.zeros_like(net["out"])}
    zeros = lambda: {k: np.zeros_like(v) for k, v in net.items()}
    state = State(net, zeros(), zeros())
    shards = min(SHARDS, max(1, n // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(shards)).cast("int"))

    def one_round(at: int, state: State):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("doc_id").combine_chunks()
            shard = group.column("shard")[0].as_py()
            text, label = group.column("text").combine_chunks(), group.column("label").to_numpy()
            own = State(dict(state.net), dict(state.first), dict(state.second), state.taken)
            return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(label)], pa.int64()), "state": pa.array([fit(own, text, label, STEPS, (at, shard)).pack()], pa.binary())})

        return run

    for at in range(ROUNDS):
        found = dealt.groupBy("shard").applyInArrow(one_round(at, state), "shard int, n bigint, state binary").orderBy("shard").collect()  # SHARDS rows
        mean = np.average([np.frombuffer(r["state"], np.float32) for r in found], axis=0, weights=[r["n"] for r in found])
        state = state.unpack(mean, state.taken + STEPS)
    return state.net


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "__qc_score") -> DataFrame:
    """``docs`` with the probability of each whole text."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    column = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.slices(batches, text):
            found = sigmoid(logits(net, *wordhash._raw(batch.column(column))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a network of the labelled ones outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, learn(docs, labels.where(~held_out(F.col("doc_id")))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__qc_score").alias("score"), (F.col("__qc_score") >= KEEP).cast("int").alias("predicted"))

"""Product quantisation in whole numbers: RDD treeAggregate over columnar part blocks.

A component x becomes the integer floor(SCALE * x); a vector is cut into
``PARTS`` consecutive parts, and each part position has a codebook of up to
``ENTRIES`` entries.  Learning is Lloyd's rounds, all of them in one pass over
the rows each:

1. A task packs the vectors of an Arrow batch into one block, component by
   component (a row of the block is a component of all its vectors).
2. Squared distances from a block's parts to the entries accumulate dimension
   by dimension in an (entries, vectors) tensor of int64; the least wins, of
   equal ones the entry of the lower index.
3. ``np.add.at`` adds the components and a one to the int64 sums and counts of
   the winning entries.  A task has one pair of tensors, whatever the number
   of its blocks, and the tasks' tensors are added along a tree of tasks
   (``treeAggregate``), so the driver adds the last few.
4. An entry with vectors becomes floor(sum / count); the others stay.

Every pass reads the table: nothing is cached, so a lost executor costs its
tasks.  The driver and the tasks hold the codebooks: PARTS * ENTRIES rows of a
part's width.  Results are exact: blocks with numbers of ``NARROW`` or more are
handled with Python's unbounded integers instead of int64.

Defined results: rows with a null vector or a null or non-finite component, or
of another length than the table's (``vectors.usable``), are dropped.  A codebook
starts with the vectors of the least distinct ids (a repeated id counts once,
with its least vector; null is the last id); with fewer ids it has fewer
entries.  A length that PARTS doesn't divide gives the first parts one
component more; a part without components has code 0.  Rows that repeat are
each encoded and each count in learning.  An error, or a sum of a label's
errors, that a long can't hold is null.  An empty table gives an empty result.
Other columns pass through ``encode``, whose columns are ``__pq_code`` and
``__pq_error``.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from agorafold.llm import common, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Numbers below this are summed and squared in int64: 2^39 vectors, or parts of 2^12 components, can't overflow.
NARROW = 1 << 24
#: Rows of error sums (one a label) that are broadcast; more are joined under salted keys.
BROADCAST_ROWS, SALTS = 200_000, 16

#: Of each part: (entries, width) integers.
Codebooks = list[np.ndarray]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a matrix, exact; int64 if all are below NARROW, else Python integers."""
    scaled = np.floor(x.astype(np.float64) * SCALE) if x.size and np.abs(x).max() < NARROW else None
    if not x.size or (scaled is not None and np.abs(scaled).max() < NARROW):
        return x.astype(np.int64) if scaled is None else scaled.astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 1 << 52 else math.floor(v * SCALE) for v in x.astype(np.float64).ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def cuts(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """The first component of each part and the one after its last."""
    ends = np.cumsum([length // parts + (p < length % parts) for p in range(parts)])
    return [(int(e) - length // parts - (p < length % parts), int(e)) for p, e in enumerate(ends)]


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of a (width, vectors) block."""
    distance = np.zeros((len(book), block.shape[1]), np.result_type(block, book, np.int64))
    for component, of_entries in zip(block, book.T, strict=True):
        apart = component[None, :] - of_entries[:, None]
        distance += apart * apart
    won = distance.argmin(axis=0)
    return won, distance[won, np.arange(block.shape[1])]


def _packed(vector: str, length: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.ascontiguousarray(integers(vectors.matrix(batch.column(vector), length)).T)
            data = pickle.dumps(block) if block.dtype == object else block.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block.dtype == object]), pa.array([block.shape[1]], pa.int64()), pa.array([data], pa.binary())], names=["wide", "n", "block"])

    return packed


def _start(rows: DataFrame, vector: str, key: str, length: int, entries: int) -> np.ndarray:
    """The integer vectors of the least ids, one an id."""
    found: dict = {}
    left = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    while len(found) < entries:  # a second time only where ids repeat among the least rows
        least = left.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
        for r in least:
            found.setdefault(r["k"], r["v"])
        if len(least) < entries or least[-1]["k"] is None:
            break
        left = left.where(F.col("k").isNull() | (F.col("k") > F.lit(least[-1]["k"])))
    first = list(found.values())[:entries]
    return integers(np.array(first, dtype=np.float64).reshape(len(first), length))


def learn(rows: DataFrame, length: int, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after all rounds. rows: as ``vectors.usable`` returns them."""
    places = cuts(length, parts)
    start = _start(rows, vector, key, length, entries)
    books = [np.ascontiguousarray(start[:, low:high]) for low, high in places]
    if not len(start):
        return books
    blocks = rows.select(vector).mapInArrow(_packed(vector, length), "wide boolean, n bigint, block binary").rdd
    zero = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]

    def add_block(books: Codebooks):
        def add(state: list, row) -> list:
            block = pickle.loads(row["block"]) if row["wide"] else np.frombuffer(row["block"], np.int64).reshape(length, row["n"])
            for p, (low, high) in enumerate(places):
                won, _ = nearest(block[low:high], books[p])
                sums, counts = state[p]
                if block.dtype == object and sums.dtype != object:
                    sums = sums.astype(object)
                for j in range(high - low):
                    np.add.at(sums[:, j], won, block[low + j])
                np.add.at(counts, won, 1)
                state[p] = (sums, counts)
            return state

        return add

    def merge(a: list, b: list) -> list:
        return [(x + y, m + n) for (x, m), (y, n) in zip(a, b, strict=True)]

    for _ in range(rounds):
        totals = blocks.treeAggregate(zero, add_block(books), merge)
        books = [np.where((n > 0)[:, None], s // np.maximum(n, 1)[:, None], b) for b, (s, n) in zip(books, totals, strict=True)]
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: Codebooks, length: int, vector: str = "embedding") -> DataFrame:
    """``rows`` with __pq_code (two hex digits a part) and __pq_error (squared distances summed over parts)."""
    schema = StructType([*rows.schema.fields, StructField("__pq_code", StringType()), StructField("__pq_error", LongType())])
    column, places = rows.columns.index(vector), cuts(length, len(books))
    hexes = np.array([f"{i:02x}" for i in range(max([1, *(len(b) for b in books)]))], dtype=object)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.ascontiguousarray(integers(vectors.matrix(batch.column(column), length)).T)
            code, error = np.full(batch.num_rows, "", dtype=object), np.zeros(batch.num_rows, np.int64)
            for book, (low, high) in zip(books, places, strict=True):
                won, apart = nearest(block[low:high], book)
                code, error = code + hexes[won], error + apart
            held = pa.array([int(e) if int(e) < 1 << 63 else None for e in error] if error.dtype == object else error, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.string()), held], names=[*batch.schema.names, "__pq_code", "__pq_error"])

    return rows.mapInArrow(encoded, schema)


def with_label_errors(coded: DataFrame, label: str, error: str, name: str, key: str) -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of the same label, nulls together.

    coded: a kept table. A label with most rows is summed before the shuffle;
    sums come back by a broadcast of a counted size, or by keys salted with ``key``.
    """
    sums = coded.groupBy(F.col(label).alias("__pq_l")).agg(F.try_sum(error).alias(name))
    same = F.col(label).eqNullSafe(F.col("__pq_l"))
    if coded.select(label).distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(sums), same, "left").drop("__pq_l")
    salted = coded.withColumn("__pq_s", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("__pq_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("__pq_s") == F.col("__pq_t")), "left").drop("__pq_l", "__pq_s", "__pq_t")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, under codebooks learned from all of them."""
    rows, length = vectors.usable(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = learn(rows, length)
    coded = common.Scratch(spark, "vector-codes").keep(encode(rows, books, length).select("vec_id", "label", F.col("__pq_code").alias("code"), F.col("__pq_error").alias("error")))
    summed = with_label_errors(coded, "label", "error", "label_error", "vec_id")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled: assignments and new entries of each as two tables."""
    part = f"""(d * {PARTS}) // (select max(len(embedding)) from kept)"""
    steps = [
        "kept as (select vec_id, label, embedding, row_number() over () as r from embeddings where embedding is not null and "
        "len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"flat as (select r, vec_id, d, {part} as p, cast(floor({SCALE} * cast(embedding[d + 1] as double)) as bigint) as x from (select *, unnest(range(len(embedding))) as d from kept))",
        f"starts as (select vec_id, min(r) as r, row_number() over (order by vec_id) - 1 as e from kept group by vec_id order by vec_id limit {ENTRIES})",
        "b0 as (select p, e, d, x from flat join starts using (r))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} as (select f.r, f.p, b.e, sum((f.x - b.x) * (f.x - b.x)) as s from flat f join b{i} b using (p, d) group by all)")
        steps.append(f"a{i} as (select r, p, arg_min(e, (s, e)) as e, min(s) as s from d{i} group by r, p)")
        if i < ROUNDS:
            steps.append(f"s{i} as (select p, e, d, sum(x) as s, count(*) as n from flat join a{i} using (r, p) group by all)")
            steps.append(f"b{i + 1} as (select b.p, b.e, b.d, case when n is null then b.x else cast((s - ((s % n) + n) % n) // n as bigint) end as x from b{i} b left join s{i} using (p, e, d))")
    return f"""with {", ".join(f"{s.split(' as (', 1)[0]} as materialized ({s.split(' as (', 1)[1]}" for s in steps)},
coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(s) as bigint) as error from a{ROUNDS} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by p, e, d)) from b{ROUNDS}) as codebooks_sha256
from coded join kept using (r)"""


OP11_SQL = _sql()

"""Resharding by minimum-cost flow.

Documents lie in old shards.  Given the old shards' sizes and the new shards'
capacities, a flow network is solved for the transfers that move the fewest
bytes: source -> old shard (its bytes) -> new shard -> sink (its capacity),
at cost 0 where old and new shard are the same and 1 a byte otherwise.

The transfers are then carried out in blocks of whole documents: an old
shard's documents, in the order of a hash, keep the first bytes where they are
and hand the following stretches to the shards that the flow names; a document
goes where its middle lies.  Every document, of any size, comes through the
flow.  Whole documents don't fill the stretches to the byte, so the same step
is repeated up to ``REPAIRS`` times from the shards as they are then, with
each shard's large documents first, so that small ones even out what large
ones left.  A shard whose largest document is over the common level keeps just
that one, and the others share the rest evenly (their capacities).

``transfers`` tells the bytes moved and the least possible for equal shards.
Only shards that lose or gain documents are rewritten.

No task holds a shard: positions are running sums over cells (size class and
hash) of each shard, a cell that lies in one stretch goes there as a whole,
and only the few cells that a stretch's end cuts are ordered row by row.  The
driver holds a row per shard.

Defined results: a null text has no bytes (its size is the ``OVERHEAD``
alone); rows that agree in every column used are interchangeable; ids may be
of any type and null; an empty table gives an empty result; other columns pass
through, internal ones start with ``__sh_``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.llm import common

SHARDS = 40
OLD_SHARDS = 32
OVERHEAD = 16
CELLS = 256
REPAIRS = 4
#: Rows of a plan (one a cell, some 60 bytes) that are broadcast at most.
BROADCAST_ROWS = 400_000


def document_size(text: Column) -> Column:
    return common.utf8_bytes(text) + F.lit(OVERHEAD)


def capacities(total: int, largest: list[int]) -> list[int]:
    """Shares of a total, as equal as the largest document of each shard allows, in whole bytes.

    The level is the greatest such that shards of max(level, largest) hold no
    more than the total.
    """
    order = sorted(range(len(largest)), key=lambda j: -largest[j])
    free, left = len(order), total
    for j in order:
        if largest[j] * free <= left:
            break
        free, left = free - 1, left - largest[j]
    level = {j: left // free + (k < left % free) for k, j in enumerate(sorted(order[len(order) - free :]))} if free else {}
    return [level.get(j, largest[j]) for j in range(len(largest))]


def min_cost_flow(supply: dict[int, int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes that each old shard sends to each new one, at the fewest bytes moved.

    Successive shortest paths on the bipartite network of shards; the sum of
    the capacities must be that of the supply.  Paths of cost 0 come first, and
    since all other arcs cost the same, a path through a reversed arc is never
    shorter than a direct one.
    """
    flow: dict[tuple[int, int], int] = {}
    left, room = dict(supply), dict(enumerate(capacity))
    # Paths of cost 0: bytes that stay.
    for i in sorted(left):
        stay = min(left[i], room.get(i, 0))
        if stay > 0:
            flow[i, i] = stay
            left[i] -= stay
            room[i] -= stay
    # Paths of cost 1, largest first, so that few transfers carry the bytes.
    surplus = [(-n, i) for i, n in left.items() if n > 0]
    deficit = [(-n, j) for j, n in room.items() if n > 0]
    heapq.heapify(surplus)
    heapq.heapify(deficit)
    while surplus:
        n, i = heapq.heappop(surplus)
        m, j = heapq.heappop(deficit)
        sent = min(-n, -m)
        flow[i, j] = flow.get((i, j), 0) + sent
        if -n > sent:
            heapq.heappush(surplus, (n + sent, i))
        if -m > sent:
            heapq.heappush(deficit, (m + sent, j))
    return flow


def _totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each shard its bytes and its largest document: a row a shard."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("__sh_shard").agg(F.sum("__sh_size"), F.max("__sh_size")).collect()}


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """For a broadcast where there can be no more than ``BROADCAST_ROWS`` rows, else for a join by shuffling."""
    return F.broadcast(rows) if most <= BROADCAST_ROWS else rows.hint("merge")


def _carried_out(rows: DataFrame, flow: dict[tuple[int, int], int], largest: dict[int, int], large_first: bool) -> DataFrame:
    """``rows`` with __sh_shard as the flow between shards wants it. largest: of each shard now its largest document."""
    spark = rows.sparkSession
    stretches, at = [], {}
    for (i, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        stretches.append((i, at.get(i, 0), at.get(i, 0) + n, j))
        at[i] = at.get(i, 0) + n
    parts = spark.createDataFrame(stretches, "o2 int, low long, high long, to int")
    parts = parts.groupBy("o2").agg(F.sort_array(F.collect_list(F.struct("low", "high", "to"))).alias("parts"))  # a row a shard
    # The last stretch that starts before a place; at a stretch's start the place belongs to it.
    there = lambda place: F.expr(f"coalesce(element_at(filter(parts, p -> p.low <= {place}), -1).to, parts[0].to)")

    kind = -(F.length(F.bin("__sh_size"))) if large_first else F.lit(0)
    cell = F.pmod(F.shiftrightunsigned(F.col("__sh_hash"), 20), F.lit(CELLS)).cast("int")
    keyed = rows.withColumns({"kind": kind.cast("int"), "cell": cell})
    cells = keyed.groupBy("__sh_shard", "kind", "cell").agg(F.sum("__sh_size").alias("bytes"))
    so_far = F.sum("bytes").over(Window.partitionBy("__sh_shard").orderBy("kind", "cell"))  # cells of a shard
    cells = cells.withColumn("before", so_far - F.col("bytes")).join(F.broadcast(parts), F.col("__sh_shard") == F.col("o2"))
    cells = cells.withColumns({"first": there("before"), "last": there("before + bytes - 1")})
    cells = cells.select(F.col("__sh_shard").alias("o"), F.col("kind").alias("k"), F.col("cell").alias("c"), "before", F.when(F.col("first") == F.col("last"), F.col("first")).alias("to"))
    # CELLS cells of each shard and size class.
    kinds = 1 + max(int(n).bit_length() for n in largest.values()) if large_first else 1
    placed = keyed.join(_bounded(cells, CELLS * len(largest) * kinds), (F.col("__sh_shard") == F.col("o")) & (F.col("kind") == F.col("k")) & (F.col("cell") == F.col("c")))
    columns = [c for c in rows.columns if c != "__sh_shard"]
    whole = placed.where("to is not null").select(*columns, F.col("to").alias("__sh_shard"))
    in_order = Window.partitionBy("__sh_shard", "kind", "cell").orderBy("__sh_hash", "__sh_size", "__sh_crc32", "doc_id")
    middle = F.col("before") + F.sum("__sh_size").over(in_order) - F.col("__sh_size") / 2
    cut = placed.where("to is null").withColumn("middle", middle).join(F.broadcast(parts), F.col("__sh_shard") == F.col("o2"))
    return whole.unionByName(cut.select(*columns, there("middle").alias("__sh_shard")))


def _assigned(rows: DataFrame, shards: int, scratch: common.Scratch) -> DataFrame:
    """``rows`` (with __sh_old) with their new shard: the flow from the old shards, then repairs."""
    now = scratch.keep(rows.withColumn("__sh_shard", F.col("__sh_old")))
    for step in range(1 + REPAIRS):
        found = _totals(now)
        supply = {i: n for i, (n, _) in found.items()}
        if not supply:
            return now
        # The first flow is to equal shards; the later ones know what lies where.
        capacity = capacities(sum(supply.values()), [found.get(j, (0, 0))[1] if step else 0 for j in range(shards)])
        if step and max(abs(supply.get(j, 0) - c) for j, c in enumerate(capacity)) <= OVERHEAD:
            break
        before, now = now, scratch.keep(_carried_out(now, min_cost_flow(supply, capacity), {i: n for i, (_, n) in found.items()}, step > 0))
        scratch.drop(before)
    return now


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """``docs`` with __sh_size, __sh_crc32, __sh_old, __sh_shard and __sh_slot.

    docs: doc_id, text and any other columns.  old_shard: where each document
    lies now (null: nowhere yet); by default a layout of ``OLD_SHARDS`` by the
    id's hash.
    """
    scratch = common.Scratch(docs.sparkSession, "reshard")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int") if old_shard is None else old_shard.cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = {"__sh_size": document_size(F.col("text")), "__sh_crc32": F.crc32(text.cast("binary")), "__sh_old": F.coalesce(old, F.lit(-1))}
    sized = docs.withColumns(facts).withColumn("__sh_hash", F.xxhash64(F.lit(8), F.col("doc_id"), F.col("__sh_crc32"), F.col("__sh_size")))
    assigned = _assigned(sized.select("doc_id", *facts, "__sh_hash"), shards, scratch)

    cell = F.pmod(F.shiftrightunsigned(F.col("__sh_hash"), 20), F.lit(CELLS)).cast("int")
    celled = assigned.withColumn("cell", cell)
    counts = celled.groupBy("__sh_shard", "cell").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("__sh_shard").orderBy("cell")) - F.col("n")
    counts = counts.select(F.col("__sh_shard").alias("s"), F.col("cell").alias("c"), first.alias("first"))
    slot = F.row_number().over(Window.partitionBy("__sh_shard", "cell").orderBy("__sh_hash", "__sh_size", "__sh_crc32", "doc_id"))
    placed = celled.withColumn("at", slot).join(_bounded(counts, CELLS * shards), (F.col("__sh_shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    placed = placed.select("doc_id", *facts, "__sh_hash", "__sh_shard", (F.col("first") + F.col("at") - 1).cast("long").alias("__sh_slot"))
    others = [c for c in docs.columns if c != "doc_id"]
    if not others or set(others) <= {"text"}:
        return placed.drop("__sh_hash")
    return _with_other_columns(sized, placed, [*facts, "__sh_hash"])


def _with_other_columns(sized: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
    """Places joined to the rows they belong to; equal rows are numbered so that each gets one place."""
    equal = Window.partitionBy("doc_id", *key).orderBy(F.lit(0))
    left = sized.withColumn("__sh_nth", F.row_number().over(equal))
    numbered = Window.partitionBy("doc_id", *key).orderBy("__sh_shard", "__sh_slot")
    right = placed.withColumn("__sh_nth", F.row_number().over(numbered))
    right = right.select(F.col("doc_id").alias("__sh_id"), *[F.col(k).alias(f"{k}_r") for k in [*key, "__sh_nth"]], "__sh_shard", "__sh_slot")
    on = F.col("doc_id").eqNullSafe(F.col("__sh_id"))
    for k in [*key, "__sh_nth"]:
        on = on & (F.col(k) == F.col(f"{k}_r"))
    return left.join(right, on).drop("__sh_id", "__sh_hash", "__sh_nth", *[f"{k}_r" for k in [*key, "__sh_nth"]])


def transfers(placed: DataFrame, shards: int = SHARDS) -> tuple[int, int]:
    """(bytes moved, the fewest that equal shards take): the second by the flow over the old shards' bytes."""
    moved = placed.groupBy("__sh_old").agg(F.sum("__sh_size"), F.coalesce(F.sum(F.when(F.col("__sh_old") != F.col("__sh_shard"), F.col("__sh_size"))), F.lit(0))).collect()  # a row a shard
    flow = min_cost_flow({r[0]: r[1] for r in moved}, capacities(sum(r[1] for r in moved), [0] * shards))
    return sum(r[2] for r in moved), sum(n for (i, j), n in flow.items() if i != j)


def affected(placed: DataFrame) -> DataFrame:
    """Shards that lose or gain documents: (shard), the ones whose files must be written anew."""
    moved = placed.where("__sh_old <> __sh_shard")
    return moved.select(F.explode(F.array("__sh_old", "__sh_shard")).alias("shard")).where("shard >= 0").distinct()


def rewrite_affected(placed: DataFrame, path: str) -> None:
    """Write the affected shards' rows under ``path``/shard=N; other shards' files stay, those of emptied shards go."""
    of = affected(placed).withColumnRenamed("shard", "__sh_a")
    rows = placed.join(F.broadcast(of), F.col("__sh_shard") == F.col("__sh_a"), "left_semi")  # a row a shard
    rows = rows.withColumn("shard", F.col("__sh_shard")).repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    emptied = of.join(placed.select("__sh_shard").distinct(), F.col("__sh_a") == F.col("__sh_shard"), "left_anti")
    for (shard,) in emptied.collect():
        common.delete(placed.sparkSession, f"{path}/shard={shard}")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of near equal bytes, with the fewest bytes moved."""
    placed = reshard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", F.col("__sh_size").alias("size"), F.col("__sh_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__sh_shard").alias("shard"),
        F.col("__sh_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__sh_old").alias("old_shard"),
    )

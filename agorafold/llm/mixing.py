"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and
share the corpus size; a target stops at ``MOST`` times its source's size and
the excess is shared again by weight.  That is water filling: one level L such
that every target is min(MOST * size, L * weight).

Copies: every document of a source gets the whole part of target/size as
certain copies.  What is left of the target is drawn without replacement: the
source's documents are divided into classes of near equal size, each class is
given a fixed number of draws, a document's inclusion probability p within its
class is in proportion to its size, and the documents with the smallest

    (u / (1 - u)) / (p / (1 - p)),   u uniform by the document's id,

are taken, which is Pareto order sampling.  The number of draws of each class
is settled from the largest class to the smallest, and what rounding leaves
over is passed on, so a source's words end near its target.

Nothing is sorted as a whole: the rank that ends a class's draws is found
from counts of equal cells of the ranking value, and only the one cell that
holds it is ranked row by row.  A source with most of the corpus is spread
over as many tasks as any other.

Defined results: a null text has size 0; size-0 documents get the certain
copies only; a null source is a source of its own; a null doc_id draws as the
id "null"; rows that share doc_id and size share one draw; an empty table
gives an empty result; other columns pass through and internal ones start
with ``__mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorafold.llm import common

MOST = 3
WEIGHTS = 3
CELLS = 1024
#: Rows of the plan (one a source and size class, some 100 bytes) that are broadcast; more are joined under salted keys.
BROADCAST_ROWS, SALTS = 200_000, 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.NOT_SPACE)), F.lit(0)).cast("long")


def targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The windows run over one row per source; no document reaches them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", ((F.row_number().over(order) - 1) % WEIGHTS + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level).withColumn("capped", F.col("level") > F.col("cap") / F.col("weight"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return levelled.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("weight"))).select("source", "source_size", F.col("target").cast("double").alias("target"))


def _size_class(size: Column) -> Column:
    """Four classes per doubling, in whole numbers; 0 for no words."""
    power = F.length(F.bin(size)) - 1
    return F.when(size <= 0, F.lit(0)).otherwise(4 * power + F.floor(size * 4 / F.pow(F.lit(2.0), power)).cast("int") - 3)


def _draw(doc_id: Column, seed: int) -> Column:
    """52 uniform bits by the id alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return digest


def _uniform(digest: Column) -> Column:
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _pareto(digest: Column, size: Column, draws: Column, n: Column, words: Column) -> Column:
    """The ranking value: random odds over inclusion odds; 0 for a certain document, null where none is drawn."""
    u = _uniform(digest)
    p = F.least(draws * size / words, F.lit(1.0))
    return F.when(draws >= n, F.lit(0.0)).when(draws > 0, (u / (1 - u)) * ((1 - p) / p))


def allocate(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Draws per class: (source, cls, n, words, certain, draws, source_size, target).

    Per source the classes (some 40 for each factor of 1000 in size) are folded
    from the largest on.
    """
    per = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "words", "squares")), asc=False).alias("cs"))
    joined = per.join(wanted.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("certain", certain).withColumn("rest", F.when(F.col("source_size") > 0, (F.col("target") - certain * F.col("source_size")) / F.col("source_size")).otherwise(F.lit(0.0)))
    folded = F.expr("""
        aggregate(filter(cs, c -> c.words > 0),
          named_struct('left', cast(0 as double), 'out', cast(array() as array<struct<cls:int,draws:bigint>>)),
          (a, c) -> named_struct(
            'left', a.left + rest * c.words - least(greatest(floor((a.left + rest * c.words) / (c.squares / c.words) + 0.5D), 0L), c.n) * (c.squares / c.words),
            'out', concat(a.out, array(named_struct('cls', c.cls, 'draws', least(greatest(floor((a.left + rest * c.words) / (c.squares / c.words) + 0.5D), 0L), c.n))))),
          a -> a.out)""")
    draws = joined.select("source", "source_size", "target", "certain", F.explode_outer(folded).alias("f")).select("source", "source_size", "target", "certain", "f.cls", "f.draws")
    right = classes.select(F.col("source").alias("__s"), F.col("cls").alias("__c"), "n", "words")
    # A source whose documents are all empty has class 0 only, without draws.
    every = right.join(wanted.select(F.col("source").alias("__w"), "source_size", "target"), F.col("__s").eqNullSafe(F.col("__w"))).drop("__w")
    every = every.join(draws.select(F.col("source").alias("__d"), "cls", "draws"), F.col("__s").eqNullSafe(F.col("__d")) & (F.col("__c") == F.col("cls")), "left")
    return every.select(
        F.col("__s").alias("source"), F.col("__c").alias("cls"), "n", "words", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("certain"),
        F.coalesce("draws", F.lit(0)).cast("long").alias("draws"),
    )


def mix(docs: DataFrame, seed: int = 10) -> DataFrame:
    """``docs`` with __mix_size, __mix_source_size, __mix_target and __mix_copies.

    docs: doc_id, text, source and any other columns.
    """
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession, "mix")
    size = words_in(F.col("text"))
    small = scratch.keep(docs.select("doc_id", F.col("source"), size.alias("size")))
    keyed = small.select("source", "size", _size_class(F.col("size")).alias("cls"), _draw(F.col("doc_id"), seed).alias("digest"))
    classes = scratch.keep(keyed.groupBy("source", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double").alias("squares")))
    wanted = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    plan = scratch.keep(allocate(classes, wanted))

    small_plan = plan.count() <= BROADCAST_ROWS

    def with_plan(rows: DataFrame, table: DataFrame, on: tuple[str, str], take: list[str], salt: Column) -> DataFrame:
        """``rows`` with the plan of their class: broadcast if small, else joined with the classes' rows spread over ``SALTS`` keys."""
        right = table.select(F.col("source").alias("__mix_s"), F.col("cls").alias("__mix_c"), *take)
        same = F.col(on[0]).eqNullSafe(F.col("__mix_s")) & (F.col(on[1]) == F.col("__mix_c"))
        if small_plan:
            return rows.join(F.broadcast(right), same, "left").drop("__mix_s", "__mix_c")
        right = right.withColumn("__mix_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__mix_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
        return salted.join(right, same & (F.col("__mix_salt") == F.col("__mix_k")), "left").drop("__mix_s", "__mix_c", "__mix_k", "__mix_salt")

    value = _pareto(F.col("digest"), F.col("size"), F.col("draws"), F.col("n"), F.col("words"))
    ranked = with_plan(keyed, plan.where("draws > 0 and draws < n"), ("source", "cls"), ["n", "words", "draws"], F.col("digest")).where("draws is not null")
    ranked = ranked.select("source", "cls", "draws", "digest", value.alias("q")).withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * CELLS).cast("int"))
    cells = ranked.groupBy("source", "cls", "cell").agg(F.count("*").alias("c"), F.max("draws").alias("draws"))
    so_far = F.sum("c").over(Window.partitionBy("source", "cls").orderBy("cell"))
    last = cells.withColumn("upto", so_far).where((F.col("upto") >= F.col("draws")) & (F.col("upto") - F.col("c") < F.col("draws")))
    last = last.select(F.col("source").alias("__s"), F.col("cls").alias("__c"), F.col("cell").alias("__cell"), (F.col("draws") - F.col("upto") + F.col("c")).alias("k"))
    inside = ranked.join(last, F.col("source").eqNullSafe(F.col("__s")) & (F.col("cls") == F.col("__c")) & (F.col("cell") == F.col("__cell")))
    at = F.row_number().over(Window.partitionBy("source", "cls", "cell").orderBy("q", "digest"))
    ends = inside.withColumn("at", at).where("at = k").select(F.col("source").alias("__s"), F.col("cls").alias("__c"), F.col("q").alias("end_q"), F.col("digest").alias("end_digest"))
    settled = plan.join(ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("cls") == F.col("__c")), "left").drop("__s", "__c")
    settled = scratch.keep(settled)

    out = docs.withColumns({"__mix_size": size, "__mix_digest": _draw(F.col("doc_id"), seed)}).withColumn("__mix_cls", _size_class(F.col("__mix_size")))
    names = ["n", "words", "source_size", "target", "certain", "draws", "end_q", "end_digest"]
    out = with_plan(out, settled, ("source", "__mix_cls"), [F.col(c).alias(f"__mix_{c}") for c in names], F.col("__mix_digest"))
    q = _pareto(F.col("__mix_digest"), F.col("__mix_size"), F.col("__mix_draws"), F.col("__mix_n"), F.col("__mix_words"))
    taken = F.when(F.col("__mix_draws") >= F.col("__mix_n"), F.lit(1)).when(
        (F.col("__mix_draws") > 0) & ((q < F.col("__mix_end_q")) | ((q == F.col("__mix_end_q")) & (F.col("__mix_digest") <= F.col("__mix_end_digest")))), F.lit(1)
    ).otherwise(F.lit(0))
    out = out.withColumn("__mix_copies", (F.col("__mix_certain") + taken).cast("long"))
    return out.drop("__mix_digest", "__mix_cls", *[f"__mix_{c}" for c in names if c not in ("source_size", "target")])


def take_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its copies, without the mix's columns."""
    repeated = mixed.withColumn("__mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("__mix_copies", F.lit(1).cast("long")))))
    return repeated.where("__mix_copies > 0").drop("__mix_i", "__mix_size", "__mix_source_size", "__mix_target", "__mix_copies")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each."""
    mixed = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
        (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"), F.col("__mix_copies").alias("copies"),
    )


_SAME = "IS NOT DISTINCT FROM"
OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1)::DOUBLE AS weight, {MOST}::DOUBLE * source_size AS cap FROM s
), v AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN level > cap / weight THEN cap ELSE max(CASE WHEN NOT level > cap / weight THEN level END) OVER () * weight END AS target FROM v
), t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t
), t3 AS (
  SELECT *, CASE WHEN source_size > 0 THEN (target - certain * source_size::DOUBLE) / source_size ELSE 0 END AS rest FROM t2
), k AS (
  SELECT *, CASE WHEN size <= 0 THEN 0 ELSE 4 * (length(bin(size)) - 1) + floor(size * 4 / pow(2.0, length(bin(size)) - 1))::INT - 3 END AS cls,
    md5('10|' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM d
), c AS (
  SELECT source, cls, count(*) AS n, sum(size)::BIGINT AS words, sum(size::HUGEINT * size)::DOUBLE AS squares FROM k GROUP BY source, cls
), o AS (
  SELECT c.*, rest, row_number() OVER (PARTITION BY c.source ORDER BY cls DESC) AS nth FROM c JOIN t3 ON c.source {_SAME} t3.source WHERE words > 0
), r AS (
  SELECT source, cls, nth, draws, surplus + rest * words - draws * (squares / words) AS surplus
  FROM (SELECT *, 0::DOUBLE AS surplus, least(greatest(floor((0::DOUBLE + rest * words) / (squares / words) + 0.5)::BIGINT, 0), n) AS draws FROM o WHERE nth = 1)
  UNION ALL
  SELECT source, cls, nth, draws, surplus + rest * words - draws * (squares / words) AS surplus
  FROM (SELECT o.*, r.surplus, least(greatest(floor((r.surplus + o.rest * words) / (squares / words) + 0.5)::BIGINT, 0), n) AS draws FROM r JOIN o ON o.source {_SAME} r.source AND o.nth = r.nth + 1)
), p AS (
  SELECT k.*, t3.source_size, t3.target, t3.certain, c.n, coalesce(r.draws, 0) AS draws, least(coalesce(r.draws, 0) * size / c.words, 1.0) AS p,
    (('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM k JOIN t3 ON k.source {_SAME} t3.source JOIN c ON k.source {_SAME} c.source AND k.cls = c.cls LEFT JOIN r ON k.source {_SAME} r.source AND k.cls = r.cls
), q AS (
  SELECT *, rank() OVER (PARTITION BY source, cls ORDER BY CASE WHEN draws > 0 THEN (u / (1 - u)) * ((1 - p) / p) END, digest) AS place FROM p
)
SELECT doc_id, size, source_size, target, (certain + CASE WHEN draws >= n OR place <= draws THEN 1 ELSE 0 END)::BIGINT * size AS taken,
  (certain + CASE WHEN draws >= n OR place <= draws THEN 1 ELSE 0 END)::BIGINT AS copies
FROM q
"""

"""A training corpus from ``documents``: five filtering and shaping stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages rows are written as Parquet and read again, so
a lost executor never reaches back beyond its stage.

Nulls, empty texts, repeated rows, empty tables and further columns are handled
as the operators' docstrings say: a document with a null text is never toxic,
a near duplicate or contaminated; it is mixed with size 0 and sharded with its
overhead only.  Rows that share a doc_id count as one document in the
near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.llm import common, decontaminate, minhash, mixing, sharding, toxicity

#: The rows depend on random draws and a learned model: no SQL expresses them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of the labelled ones doesn't reject."""
    labelled = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    machine = toxicity.learned(spark, common.table(spark, sf_dir, "documents").select("doc_id", "text"), labelled)
    scored = toxicity.score(docs, machine, name="__tx_score")
    return scored.where(F.col("__tx_score") < toxicity.REJECT).drop("__tx_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, least=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    marked = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return decontaminate.remove_documents(marked)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.take_copies(mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, shard and place in it; a name that is taken keeps its prefix ``__sh_``."""
    placed = sharding.reshard(docs)
    added = [F.col(f"__sh_{c}").alias(c if c not in docs.columns else f"__sh_{c}") for c in ("size", "shard", "slot")]
    return placed.select(*docs.columns, *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to sharded rows."""
    docs, scratch = common.table(spark, sf_dir, "documents"), common.Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

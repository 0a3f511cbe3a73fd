"""Sums that are kept: what changed rows were is taken back, what they are is added.

A fold gives a state before and after a batch.  Rows that differ give signed
contributions (new minus old), these are summed by group before any shuffle of
the kept sums, and the kept sums of those groups alone change.  The sums after
any cut of a log are those of the whole state, and a batch that comes again
changes no row and so no sum.  Where only some buckets of a state are read,
before and after must be of the same buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.operators import folds
from agorafold.sources import fixture_log, oplog, sinks

VOTE_SUMS = "author string, permlink string, rshares decimal(38,0), abs_rshares decimal(38,0), total_votes long, net_votes long, votes long"
FOLLOW_SUMS = "account string, side string, n long"


def deltas(before: DataFrame, after: DataFrame, row: list[str], group: list[str], measures: dict[str, Column]) -> DataFrame:
    """(group, measures): by how much each group's sums have changed; groups without a change are left out.

    row: the key of a state row; measures: its contributions, 0 for none.
    """
    side = lambda rows, sign: rows.select(*row, *[g for g in group if g not in row], *[(sign * m).alias(n) for n, m in measures.items()])
    both = side(after, F.lit(1)).unionByName(side(before, F.lit(-1)))
    keys = list(dict.fromkeys([*row, *group]))
    net = both.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures]).where(" or ".join(f"{n} <> 0" for n in measures))
    return net.groupBy(*group).agg(*[F.sum(n).alias(n) for n in measures]).where(" or ".join(f"{n} <> 0" for n in measures))


def merged(kept: DataFrame, changes: DataFrame, group: list[str], count: str) -> DataFrame:
    """Kept sums with changes added; groups whose ``count`` falls to 0 go."""
    names = [c for c in kept.columns if c not in group]
    both = kept.unionByName(changes.select(*kept.columns))
    return both.groupBy(*group).agg(*[F.sum(n).cast(kept.schema[n].dataType).alias(n) for n in names]).where(F.col(count) != 0)


def touched(state: DataFrame, last: int | None) -> DataFrame:
    """Rows that a batch up to block ``last`` may have changed, or has: a changed row has a block of the batch, and had an older one.

    What it leaves out of the states before and after the batch is the same.
    """
    return state if last is None else state.where(F.col("block_num") <= last)


def vote_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    rshares = F.col("rshares").cast("decimal(38,0)")
    measures = {"rshares": rshares, "abs_rshares": F.abs(rshares), "total_votes": F.col("is_effective").cast("long"), "net_votes": F.signum("rshares").cast("long"), "votes": F.lit(1).cast("long")}
    return deltas(before, after, ["voter", "author", "permlink"], ["author", "permlink"], measures)


def follow_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of followers and of followed accounts."""
    sides = F.inline(F.array(F.struct(F.col("follower").alias("account"), F.lit("following").alias("side")), F.struct(F.col("following").alias("account"), F.lit("followers").alias("side"))))
    counted = lambda rows: rows.where("kind = 'follow'").select("follower", "following", sides)
    return deltas(counted(before), counted(after), ["follower", "following"], ["account", "side"], {"n": F.lit(1).cast("long")})


def _kept(spark: SparkSession, log: DataFrame, fold, schema: str, of, group: list[str], count: str, sums: str, cut: int) -> DataFrame:
    """The sums after two parts of a log and the first part once more, each from the change of the state."""
    shared = sinks.Shared(spark, "sums")
    log, state, found = shared.keep(log), sinks.nothing(spark, schema), sinks.nothing(spark, sums)
    for first, last in ((None, cut), (cut + 1, None), (None, cut)):
        before, state = state, shared.keep(fold(state, oplog.scan(log, first, last)))
        found = shared.keep(merged(found, of(touched(before, last), touched(state, last)), group, count))
    return found


def vote_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote roll-up of every post, kept over batches."""
    found = _kept(spark, fixture_log.votes(spark, sf_dir), folds.fold_votes, folds.VOTES, vote_deltas, ["author", "permlink"], "votes", VOTE_SUMS, fixture_log.FIRST + 1200)
    return found.withColumns({n: F.col(n).cast("long") for n in ("rshares", "abs_rshares")})


def follow_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many each account follows and is followed by, kept over batches with unfollows and resets."""
    return _kept(spark, fixture_log.follows(spark, sf_dir), folds.fold_follows, folds.EDGES, follow_deltas, ["account", "side"], "n", FOLLOW_SUMS, fixture_log.FIRST + 160)

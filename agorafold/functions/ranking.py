"""Scores of posts and of votes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking and notification rules.
RSHARES_UNIT = 10_000_000.0
HOT_SECONDS = 10_000.0
TRENDING_SECONDS = 240_000.0


def epoch_seconds(at: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.unix_timestamp(at.cast("timestamp"))


def signed_log(rshares: Column) -> Column:
    """log10 of the vote weight, at least 0, with the weight's sign; zero counts as negative."""
    weight = rshares.cast("double") / RSHARES_UNIT
    size = F.log10(F.greatest(F.abs(weight), F.lit(1.0)))
    return F.when(weight > 0, size).otherwise(-size)


def hot(rshares: Column, created: Column) -> Column:
    return (signed_log(rshares) + epoch_seconds(created) / HOT_SECONDS).cast("float")


def trending(rshares: Column, created: Column) -> Column:
    return (signed_log(rshares) + epoch_seconds(created) / TRENDING_SECONDS).cast("float")


def vote_value(payout: Column, post_rshares: Column, rshares: Column) -> Column:
    """Share of a post's payout that a vote stands for."""
    return F.when(post_rshares != 0, payout.cast("double") / post_rshares * rshares).otherwise(F.lit(0.0))


def vote_score(payout: Column, abs_rshares: Column, rshares: Column) -> Column:
    """0 without votes, -1 below 20 thousandths, else 25 a digit beyond the first, 100 at most."""
    value = payout.cast("double") / abs_rshares * 1000 * rshares
    digits = F.length(F.round(value).cast("long").cast("string"))
    return F.when(abs_rshares == 0, 0).when(value < 20, -1).otherwise(F.least(F.lit(100), (digits - 1) * 25))


def vote_payload(value: Column) -> Column:
    """``($1.23)`` for a value of a cent or more, else nothing; what is less than 1e-12 below half a cent is rounded up."""
    amount = F.round(value.cast("string").cast("decimal(30,12)"), 2).cast("decimal(30,2)")
    return F.when(value < 0.01, "").otherwise(F.concat(F.lit("($"), amount.cast("string"), F.lit(")")))


def flag_weight(rshares: Column) -> Column:
    """Digits of half the negative vote weight beyond 11."""
    half = F.floor(F.greatest(-rshares, F.lit(0)) / 2).cast("string")
    return F.greatest(F.length(half) - 11, F.lit(0))

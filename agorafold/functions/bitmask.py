"""Sets of small numbers (reasons for muting) as bits of an integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons for muting, by bit.
REASONS = {
    0: "MUTED_COMMUNITY_MODERATION",
    1: "MUTED_COMMUNITY_TYPE",
    2: "MUTED_PARENT",
    3: "MUTED_REPUTATION",
    4: "MUTED_ROLE_COMMUNITY",
}


def encode(reasons: Column) -> Column:
    """The integer of an array of reasons."""
    return F.aggregate(reasons, F.lit(0), lambda mask, r: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1), r)))


def decode(mask: Column) -> Column:
    """The array of reasons of an integer, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(30)), lambda r: F.call_function("shiftleft", F.lit(1), r).bitwiseAND(mask) != 0)


def names(mask: Column) -> Column:
    """The reasons' names, in the order of their bits."""
    known = F.array(*[F.lit(REASONS[k]) for k in sorted(REASONS)])
    return F.transform(F.filter(decode(mask), lambda r: r < len(REASONS)), lambda r: F.get(known, r))


def filter_mask(reasons: list[int]) -> int:
    """The integer of reasons that a caller wants left out."""
    if any(r not in REASONS for r in reasons):
        raise ValueError("a reason for muting must be one of 0 to 4")
    return sum({1 << r for r in reasons})

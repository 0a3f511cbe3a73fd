"""Notification identifiers: seconds since genesis, type and counter in one long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorafold.functions.ranking import epoch_seconds

# First block's time, seconds a block, bits of type and counter.
GENESIS = "2016-03-24 16:05:00"
BLOCK_SECONDS = 3
TYPE_BITS, COUNTER_BITS = 6, 22


def _genesis() -> Column:
    return F.unix_timestamp(F.lit(GENESIS))


def pack(created: Column, kind: Column, counter: Column) -> Column:
    seconds = (epoch_seconds(created) - _genesis()).cast("long")
    return F.shiftleft(F.shiftleft(seconds, TYPE_BITS).bitwiseOR(kind.cast("long")), COUNTER_BITS).bitwiseOR(counter.cast("long"))


def unpack(packed: Column) -> Column:
    """struct(created, kind, counter)."""
    return F.struct(
        F.timestamp_seconds(F.shiftright(packed, TYPE_BITS + COUNTER_BITS) + _genesis()).cast("timestamp_ntz").alias("created"),
        F.shiftright(packed, COUNTER_BITS).bitwiseAND(F.lit((1 << TYPE_BITS) - 1).cast("long")).cast("int").alias("kind"),
        packed.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1).cast("long")).cast("int").alias("counter"),
    )


def block_before(head: Column, seconds: int) -> Column:
    """Number of the block that lies the given time before a head block."""
    return (head - seconds // BLOCK_SECONDS).cast("long")

"""Reputation as it is shown and as it scores notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display(raw: Column) -> Column:
    """25 for none; else 9 for each order of magnitude beyond 9, with four digits' precision, from 25 up or down."""
    size = F.abs(raw).cast("decimal(38,0)")
    digits = F.length(size.cast("string"))
    lead = F.when(digits >= 4, F.substring(size.cast("string"), 1, 4).cast("int")).otherwise((size * F.pow(F.lit(10.0), 4 - digits)).cast("int"))
    mantissa = F.log10(lead.cast("double")) + 0.00000001
    level = F.greatest(digits - 1 + (mantissa - F.floor(mantissa)) - 9, F.lit(0.0))
    return F.when(raw == 0, F.lit(25.0)).otherwise(F.round(F.when(raw < 0, -level).otherwise(level) * 9 + 25, 2))


def notification_score(raw: Column) -> Column:
    """Whole number from 25 for no reputation, 7.5 for each order of magnitude beyond 9."""
    level = F.greatest(F.log10(F.abs(raw.cast("double"))) - 9, F.lit(0.0))
    return F.round(F.coalesce(level, F.lit(0.0)) * F.when(raw < 0, -1).otherwise(1) * 7.5 + 25).cast("int")

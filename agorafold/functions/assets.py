"""Amounts of money in text and as (amount, identifier, precision) objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies, their identifiers and digits after the point.
IDENTIFIERS = {"HBD": ("@@000000013", 3), "HIVE": ("@@000000021", 3), "VESTS": ("@@000000037", 6)}
# Old currency names.
ALIASES = {"SBD": "HBD", "STEEM": "HIVE"}


def _choice(key: Column, table: dict[str, object]) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def parse(text: Column) -> Column:
    """struct(amount, currency) of ``1.001 HBD``; null where the text is none."""
    parts = F.split(text, " ")
    name = F.get(parts, F.lit(1))
    current = F.coalesce(_choice(name, ALIASES), name)
    amount = F.get(parts, F.lit(0)).try_cast("decimal(38,6)")
    return F.when(amount.isNotNull() & current.isin(*IDENTIFIERS), F.struct(amount.alias("amount"), current.alias("currency")))


def from_object(amount: Column, precision: Column, identifier: Column) -> Column:
    """struct(amount, currency) of whole units, digits and identifier."""
    name = _choice(identifier, {i: c for c, (i, _) in IDENTIFIERS.items()})
    value = (amount.cast("decimal(38,0)") / F.pow(F.lit(10), precision).cast("decimal(20,0)")).cast("decimal(38,6)")
    return F.struct(value.alias("amount"), name.alias("currency"))


def to_object(amount: Column, currency: Column) -> Column:
    """struct(amount as text, identifier, precision)."""
    digits = _choice(currency, {c: p for c, (_, p) in IDENTIFIERS.items()})
    whole = F.round(amount.cast("decimal(28,6)") * F.pow(F.lit(10), digits).cast("decimal(10,0)"), 0).cast("decimal(38,0)").cast("string")
    return F.struct(whole.alias("amount"), _choice(currency, {c: i for c, (i, _) in IDENTIFIERS.items()}).alias("nai"), digits.alias("precision"))

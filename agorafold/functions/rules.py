"""Rules of muting and of notifications, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Community types, the least role of a member, least figures of a vote that is told, early blocks and their scale.
TOPIC, JOURNAL, COUNCIL = 1, 2, 3
MEMBER = 2
LEAST_RSHARES, LEAST_VALUE = 10_000_000_000, 0.02
EARLY_BLOCK, EARLY_SCALE = 905_693, 1_000_000
TYPE_BIT, PARENT_BIT = 1 << 1, 1 << 2
GRAYED = -464_800_000_000


def root_is_muted(kind: Column, role: Column) -> Column:
    """A root post is muted by its community's type: never in topics or without one; in journals and councils unless by a member."""
    return F.coalesce(kind.isin(JOURNAL, COUNCIL) & (F.coalesce(role, F.lit(0)) < MEMBER), F.lit(False))


def reply_is_muted(kind: Column, role: Column) -> Column:
    """A reply is muted by type in councils only, unless by a member."""
    return F.coalesce((kind == COUNCIL) & (F.coalesce(role, F.lit(0)) < MEMBER), F.lit(False))


def muted_reasons(is_root: Column, kind: Column, role: Column, parent_muted: Column) -> Column:
    """The bits of a new post: its community's type, and a muted parent."""
    by_type = F.when(is_root, root_is_muted(kind, role)).otherwise(reply_is_muted(kind, role))
    return F.when(by_type, TYPE_BIT).otherwise(0).bitwiseOR(F.when(~is_root & F.coalesce(parent_muted, F.lit(False)), PARENT_BIT).otherwise(0))


def rshares(block: Column, raw: Column) -> Column:
    """Votes of the first blocks counted in a coarser unit."""
    return F.when(block < EARLY_BLOCK, raw * EARLY_SCALE).otherwise(raw)


def vote_is_told(voter: Column, author: Column, score: Column, weight: Column, value: Column, muted: Column) -> Column:
    """A vote that its author hears of."""
    return (score >= 0) & (weight >= LEAST_RSHARES) & (value >= LEAST_VALUE) & (voter != author) & ~F.coalesce(muted, F.lit(False))


def is_grayed(reputation: Column) -> Column:
    return reputation <= GRAYED


def payload_is_valid(document: Column, required: dict[str, str], optional: dict[str, str] | None = None) -> Column:
    """A JSON object with all required keys, no others than these and the optional ones, each of its type ("string", "number", "boolean", "object", "array")."""
    types = {"string": ["STRING"], "number": ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
    parsed = F.try_parse_json(document)
    keys = F.json_object_keys(document)
    every = required | (optional or {})
    ok = parsed.isNotNull() & keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, every)))) == 0)
    for name, kind in every.items():
        part = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        is_kind = F.regexp_extract(part, "^[A-Z]+", 0).isin(*types[kind])
        there = F.array_contains(keys, name)
        ok = ok & (F.when(there, F.coalesce(is_kind, F.lit(False))).otherwise(F.lit(name not in required)))
    return F.coalesce(ok, F.lit(False))

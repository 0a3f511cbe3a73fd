"""The operation log: one row per operation, ordered by ``op_id``, bodies in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op_id long, block_num int, block_ts timestamp_ntz, op_type int, body string"
# Operation types by name, and the custom documents that are read.
TYPES = {
    "vote": 0, "comment": 1, "account_create": 9, "account_update": 10, "pow": 14, "delete_comment": 17, "custom_json": 18, "comment_options": 19, "account_create_delegated": 23,
    "pow2": 30, "create_claimed_account": 41, "account_update2": 43, "author_reward": 51, "comment_reward": 53, "payout_update": 61, "effective_vote": 72, "ineffective_delete": 73,
}
CUSTOM = ("follow", "reblog", "community", "notify")


def scan(log: DataFrame, first: int | None = None, last: int | None = None, types: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """Operations of a block range (open where None) and of given types; the range and types reach the file scan."""
    rows = log.where(F.col("op_type").isin(*[TYPES[t] for t in types]))
    if first is not None:
        rows = rows.where(F.col("block_num") >= first)
    if last is not None:
        rows = rows.where(F.col("block_num") <= last)
    return rows


def field(name: str):
    return F.get_json_object("body", f"$.{name}")


def fields(rows: DataFrame, keep: list[str], *names: str) -> DataFrame:
    """``keep`` and fields of the bodies as texts; each body is parsed once."""
    row = parsed(rows, keep, F.from_json("body", ", ".join(f"{n} string" for n in names)).alias("__b"))
    return row.select(*keep, *[F.col(f"__b.{n}").alias(n) for n in names])


def blocks(log: DataFrame) -> DataFrame:
    """(block_num, block_ts, previous_ts): one row per block with the time of the one numbered before, or its own without one."""
    each = log.groupBy("block_num").agg(F.min("block_ts").alias("block_ts"))
    before = each.select((F.col("block_num") + 1).alias("next"), F.col("block_ts").alias("previous"))
    return each.join(before, F.col("block_num") == F.col("next"), "left").select("block_num", "block_ts", F.coalesce("previous", "block_ts").alias("previous_ts"))


def parsed(rows: DataFrame, keep: list[str], *values) -> DataFrame:
    """``keep`` and some values, each worked out once a row.

    Later filters and projections read the values; the optimizer can't move
    their expressions, such as parses of JSON, into each place of use.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*values))))


def custom(log: DataFrame) -> DataFrame:
    """Custom documents as (op_id, block_num, block_ts, kind, account, action, data); bad ones are left out.

    A document is ``[action, {...}]`` or an object alone, signed by one account.
    """
    place = ["op_id", "block_num", "block_ts"]
    rows = parsed(scan(log, types=("custom_json",)), place, F.from_json("body", "id string, required_posting_auths array<string>, required_auths array<string>, json string").alias("b"))
    account = F.coalesce(F.get("b.required_posting_auths", 0), F.get("b.required_auths", 0))
    rows = rows.where(F.col("b.id").isin(*CUSTOM) & account.isNotNull()).select(*place, F.col("b.id").alias("kind"), account.alias("account"), F.col("b.json").alias("doc"))
    pair = parsed(rows, [*place, "kind", "account", "doc"], F.try_parse_json("doc").isNotNull().alias("good"), F.get_json_object("doc", "$[0]").alias("first"), F.get_json_object("doc", "$[1]").alias("second")).where("good")
    return pair.select(*place, "kind", "account", F.coalesce("first", "kind").alias("action"), F.when(F.col("first").isNotNull(), F.col("second")).otherwise(F.col("doc")).alias("data"))


def from_block_files(spark: SparkSession, path: str, started: str = "2016-03-24 16:05:00") -> DataFrame:
    """A log from files that map block numbers to transactions of operations (test input).

    Blocks are 3 seconds apart; operations are numbered in the order of block,
    transaction and place.
    """
    shape = "map<string, struct<transactions: array<struct<operations: array<struct<type: string, value: string>>>>>>"
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("block", "b"))
    trx = files.select(F.col("block").cast("int").alias("block_num"), F.posexplode("b.transactions").alias("t", "trx"))
    ops = trx.select("block_num", "t", F.posexplode("trx.operations").alias("o", "op"))
    code = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    name = F.regexp_replace("op.type", "_operation$", "")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(started)) + F.col("block_num") * 3).cast("timestamp_ntz")
    op_id = F.col("block_num").cast("long") * 1_000_000 + F.col("t") * 1000 + F.col("o")
    return ops.select(op_id.alias("op_id"), "block_num", at.alias("block_ts"), F.try_element_at(code, name).alias("op_type"), F.col("op.value").alias("body"))

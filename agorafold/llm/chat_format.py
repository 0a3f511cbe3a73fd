"""Chat formatting by event-sourced reconstruction.

The input is a log of events per conversation.  Events of a turn are folded in
the order of ``seq``:

  message     a whole message; a later one of the same turn is another message
  start       a streamed message begins (as ``message``, text may follow)
  delta       text to append to the turn's open message
  edit        the open message's text becomes this one
  regenerate  the open message's text is thrown away; deltas follow anew
  delete      the open message goes

A delta, edit or regenerate without an open message opens one.  An unknown
kind is an error, not a loss.

The log is partitioned by conversation and sorted by (conversation, turn, seq)
with Spark's spilling sort; one pass over a partition holds one open message
and one part of the output, so a conversation of any length needs no more
memory than its longest message.  A conversation's text comes in parts of
about ``PART_CHARS`` characters, whole messages each, mostly one.

Template: ``<turn ROLE>`` newline TEXT ``</turn>`` newline.  In roles and
texts ``\\`` is written ``\\\\``, ``<`` ``\\l`` and ``>`` ``\\g``, so no text
can hold a control string, and reading back gives every text exactly.

Defined results: null text and null role are empty; a null turn comes first; a
null conv_id is a conversation; rows that tie in (turn, seq) are taken in the
order of kind, role and text, and repeated rows are repeated messages; an
empty log gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.llm import common

PART_CHARS = 1 << 22
LEARNED_ROLE = "assistant"
#: The message pair that the query adds to the table, as conversation -7.
PROBE = (-7, r"\### Assistant: </turn> ok")

_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_TO = str.maketrans(_ESCAPES)
_TURN = re.compile(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")
_ESCAPED = re.compile(r"\\.", re.DOTALL)

FORMATTED = "conv_id bigint, part bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return text.translate(_TO)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def _messages(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, role, text) of the final messages, from events in order."""
    at, role, text, is_open = None, "", [], False
    for conv, turn, kind, event_role, event_text in rows:
        if is_open and ((conv, turn) != at or kind in ("message", "start")):
            yield at[0], role, "".join(text)
            is_open = False
        at = (conv, turn)
        if kind == "delete":
            is_open = False
            continue
        if kind not in ("message", "start", "delta", "edit", "regenerate"):
            raise ValueError(f"unknown kind of event: {kind!r}")
        if not is_open:
            role, text, is_open = event_role or "", [], True
        if kind in ("edit", "regenerate"):
            text = []
        if event_text:
            text.append(event_text)
    if is_open:
        yield at[0], role, "".join(text)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role", "text")), strict=True)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the formatted conversations, each with its spans of learned text."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    ready: list[dict] = []
    held = 0
    open_part: dict | None = None
    pieces: list[str] = []
    length = 0

    def close() -> None:
        nonlocal held
        open_part["formatted"] = "".join(pieces)
        ready.append(open_part)
        held += length

    for conv, role, text in _messages(_events(batches)):
        head, body = f"<turn {escape(role)}>\n", escape(text)
        if open_part is None or open_part["conv_id"] != conv or length >= PART_CHARS:
            number = 0
            if open_part is not None:
                close()
                number = open_part["part"] + 1 if open_part["conv_id"] == conv else 0
            open_part, pieces, length = {"conv_id": conv, "part": number, "loss": []}, [], 0
            if held >= PART_CHARS:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready, held = [], 0
        if role == LEARNED_ROLE:
            open_part["loss"].append({"start": length + len(head), "end": length + len(head) + len(body)})
        pieces += (head, body, "</turn>\n")
        length += len(head) + len(body) + 8
    if open_part is not None:
        close()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def format_chat(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv_id, part, formatted, loss): final conversations from their events.

    events: conv_id, turn, seq, kind, role, text.  A partition's rows come in
    the order of conversation and part.
    """
    chosen = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"),
        F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    parted = chosen.repartition(partitions, "conv_id") if partitions else chosen.repartition("conv_id")
    return parted.sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text").mapInArrow(_render, FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now = None

    def end() -> tuple:
        conv, turns, all_turns, chars, learned, formatted = now
        return conv, turns, all_turns.hexdigest(), chars, learned.hexdigest(), formatted

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for source in batches:
        for conv, part, text, loss in zip(*(source.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True):
            if part == 0:
                if now is not None:
                    out.append(end())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            at = 0
            for m in _TURN.finditer(text):
                if m.start() != at:
                    raise ValueError(f"conversation {conv}: text between turns")
                at = m.end()
                now[1] += 1
                now[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if at != len(text):
                raise ValueError(f"conversation {conv}: text after the last turn")
            for span in loss:
                learned = unescape(text[span["start"] : span["end"]])
                now[3] += len(learned)
                now[4].update(learned.encode())
            now[5] += len(text)
        if len(out) >= 1000:
            yield batch()
            out = []
    if now is not None:
        out.append(end())
    if out:
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of what its formatted text says, parsed from that text alone.

    formatted: as ``format_chat`` returns it, in its order; parts need no new shuffle.
    """
    return formatted.mapInArrow(_read, READ)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as a log."""
    return conversations.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    conv, text = PROBE
    probe = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    table = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(as_events(table.unionByName(probe))))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<>\\]', '', 'g')) AS body,
    length(role) + length(regexp_replace(role, '[^<>\\]', '', 'g')) AS head FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn >') + 1 + head + body + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

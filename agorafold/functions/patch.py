"""Bodies edited by patches: texts of ``@@ -start,size +start,size @@`` parts with kept, removed and added lines.

Lines begin with a space, ``-`` or ``+`` and are percent-encoded.  A part is
applied where its kept and removed text stands nearest to the named place;
a part whose text isn't found is left out.  A text that isn't a patch is a
whole new body.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = re.compile(r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@$")


def parse(text: str) -> list[tuple[int, str, str]] | None:
    """(place, text before, text after) of each part; None for what isn't a patch."""
    parts: list[tuple[int, str, str]] = []
    for line in text.split("\n"):
        head = _HEAD.match(line)
        if head:
            # Places count from 1, but from 0 where a part has no text of its own.
            parts.append((int(head[1]) - (head[2] != "0"), "", ""))
        elif not line:
            continue
        elif not parts or line[0] not in " -+":
            return None
        else:
            at, old, new = parts[-1]
            piece = unquote(line[1:])
            parts[-1] = (at, old + piece * (line[0] != "+"), new + piece * (line[0] != "-"))
    return parts or None


def merge(old: str, edit: str) -> str:
    """The body after an edit."""
    parts = parse(edit)
    if parts is None:
        return edit
    shift = 0
    for at, before, after in parts:
        place = max(0, at + shift)
        right, left = old.find(before, place), old.rfind(before, 0, place + len(before))
        found = min((p for p in (right, left) if p >= 0), key=lambda p: abs(p - place), default=-1)
        if found >= 0:
            old = old[:found] + after + old[found + len(before) :]
            shift += found - place + len(after) - len(before)
    return old


def merged(body: Column, edits: Column) -> Column:
    """A body (null: none) after an array of edits, in order; batches without any pass at once.

    No edits are handed over as an empty array: Spark measures an Arrow batch
    after each row, and of a column of null arrays it reads all rows again.
    """

    @F.arrow_udf("string")
    def run(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        if not len(lists.flatten()):
            return pc.fill_null(bodies, "")
        out = []
        for text, own in zip(bodies.to_pylist(), lists.to_pylist(), strict=True):
            now = text or ""
            for edit in own:
                now = merge(now, edit or "")
            out.append(now)
        return pa.array(out, pa.string())

    return run(body, F.coalesce(edits, F.array().cast("array<string>")))

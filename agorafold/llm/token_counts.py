"""Byte-pair token counts without token identifiers.

A pre-token's symbols are its bytes.  A heap holds the adjacent pairs that the
merge list ranks; the lowest rank (leftmost first) is popped again and again
and its two nodes of a linked list become one.  The count is the number of
initial symbols minus the number of merges, so no identifier is ever made.
A pre-token of n bytes costs O(n log n), also when a text is one long run.

Texts repeat their words, so each Python worker keeps the counts of short
pre-tokens, and of short stretches between two lone spaces, in tables of
bounded size.  Such a stretch starts and ends with a visible character, so its
pre-tokens, with the space before it, don't depend on what stands around it.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id
stays null; repeated rows are counted each; an empty table gives an empty
result; other columns are not read unless named in ``keep``.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.llm import common

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Entries of a worker's table of counts, and the longest pre-token (code points) it keeps.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 32


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies.

    Fixed rule: bytes 33-126, 161-172 and 174-255 stand for themselves, the
    others for the code points from 256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PairCounter:
    """Counts the tokens of texts under one byte-level merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only plain byte-level vocabularies are counted")
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: an option of this vocabulary is not supported")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = byte_symbols()
        if not set(symbols) <= set(model["vocab"]):
            raise ValueError(f"{path}: a byte has no symbol")
        # Inside, a symbol is a small number: a byte, or a place in the list of merged strings.
        number = {x: b for b, x in enumerate(symbols)}
        for left, right in pairs:
            number.setdefault(left + right, len(number))
        # Of a pair of numbers, rank and number of the merged symbol.
        self.ranks = {number[a] << 20 | number[b]: (r << 32, number[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_texts = special
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.joint = regex.compile(r" \s|\s ").search
        self.cache: dict[str, int] = {}
        self.stretches: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token: symbols minus merges."""
        part = list(piece.encode("utf-8", "surrogatepass"))
        n = len(part)
        ranked = self.ranks.get
        heap = [found[0] | i for i in range(n - 1) if (found := ranked(part[i] << 20 | part[i + 1]))]
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j < 0 or part[i] < 0:
                continue
            found = ranked(part[i] << 20 | part[j])
            if not found or found[0] | i != top:  # one of the two has been merged since
                continue
            part[i] = now = found[1]
            part[j] = -1
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := ranked(now << 20 | part[k]):
                    heapq.heappush(heap, found[0] | i)
            h = before[i]
            if h >= 0 and (found := ranked(part[h] << 20 | now)):
                heapq.heappush(heap, found[0] | h)
        return n - merges

    def _kept(self, table: dict[str, int], key: str, found: int) -> int:
        if len(key) <= CACHE_CHARS:
            if len(table) >= CACHE_ENTRIES:
                table.clear()
            table[key] = found
        return found

    def pieces(self, text: str) -> int:
        """Tokens of a text, pre-token by pre-token."""
        total = 0
        for piece in self.split(text):
            found = self.cache.get(piece)
            total += self._kept(self.cache, piece, self.merged(piece)) if found is None else found
        return total

    def plain(self, text: str) -> int:
        if self.joint(text):  # a space beside other white space: a run of white space is split by what follows it
            return self.pieces(text)
        first, *rest = text.split(" ")
        found = list(map(self.stretches.get, rest))
        if None in found:
            found = [self._kept(self.stretches, x, self.pieces(" " + x)) if c is None else c for x, c in zip(rest, found, strict=True)]
        return self.pieces(first) + sum(found)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token."""
        if self.special is None or not any(s in text for s in self.special_texts):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> PairCounter:
    return PairCounter(path)


def token_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns, n_bytes and n_tokens of every row's whole text.

    ``vocabulary`` names a byte-level .json file of the installed vocabulary
    package; each worker opens its own installed copy.
    """
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], common.utf8_bytes(F.col(text)).alias("n_bytes"), F.col(text).cast("string").alias("t"))
    kept = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "n_tokens bigint"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(public_tokenizers.path(vocabulary))
        for batch in batches:
            tokens = [0 if t is None else counter.count(t) for t in (x.as_py() for x in batch.column("t"))]
            columns = [batch.column(k) for k in [*kept, "n_bytes"]] + [pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_bytes", "n_tokens"])

    return chosen.mapInArrow(measure, schema).select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "n_bytes", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    counted = token_counts(common.table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

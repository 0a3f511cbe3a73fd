"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps, per document,
the measurements and one 64-bit integer in which bit r says that rule r
failed.  A policy is a named set of rules, so a verdict is one bitwise AND on
the ledger, another version of a policy needs no second look at the texts, and
an ablation is an aggregation over the few distinct masks.

Defined results: a null or empty text has no words and measures 0, so it fails
``few_words``; a null doc_id is kept as null; repeated rows give repeated
ledger rows; an empty table gives an empty ledger; other columns of the input,
whatever their names, are not read unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.llm import common, wordhash

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_stutter")

#: Rule r sets bit r. Integer arithmetic, so that every engine agrees.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("capitals", "n_upper > n_lower"),
    ("stutter", "10 * n_stutter > 3 * n_words"),
]
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "shape": (*BASE, "short_words", "long_words", "capitals", "symbols"),
    "default": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "capitals", "stutter"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    at = {name: r for r, (name, _) in enumerate(RULES)}
    return sum(1 << at[name] for name in rules)


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text of an array."""
    w = wordhash.words(texts)
    n, data, offsets = len(texts), w.data, w.offsets
    out = {
        "n_words": w.counts,
        "word_chars": wordhash.per_text(wordhash._WORD[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": wordhash.per_text(_SYMBOL[data], offsets),
        "n_upper": wordhash.per_text(_UPPER[data], offsets),
        "n_lower": wordhash.per_text(_LOWER[data], offsets),
    }

    # Lines that have a word: from a line's first byte to before its \n or the text's end.
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start, "left")], offsets[doc + 1])
    first_word = np.searchsorted(w.start, start, "left")
    worded = np.append(w.start, len(data))[first_word] < end
    start, end, doc = start[worded], end[worded], doc[worded]
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[_later_equal(wordhash.span_hashes(data, start, end), doc)], minlength=n)

    each = w.hashes()
    again = (each[1:] == each[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["n_stutter"] = np.bincount(w.doc[1:][again], minlength=n)
    at, h = w.windows(each, WINDOW)
    twice = at[_found_twice(h, w.doc[at])]
    cover = np.zeros(len(w.doc) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def _keyed(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = wordhash.mix(h ^ wordhash.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, key[1:] == key[:-1]


def _later_equal(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indexes of values that equal an earlier one of the same text."""
    order, same = _keyed(h, doc)
    return order[1:][same]


def _found_twice(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indexes of values that are found at least twice in their text."""
    order, same = _keyed(h, doc)
    return order[np.append(same, False) | np.insert(same, 0, False)] if len(h) else order


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: the ``keep`` columns, ``MEASURES`` and ``failed`` (the bits)."""
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(chosen.schema.fields[:-1])), *(f"{m} bigint" for m in MEASURES)])
    kept = [f"k{i}" for i in range(len(keep))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.slices(batches, "t"):
            found = _measure(batch.column("t"))
            columns = [batch.column(k) for k in kept] + [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *MEASURES])

    bits = sum((F.when(F.expr(rule), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    return chosen.mapInArrow(measure, schema).select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *MEASURES, bits.alias("failed"))


def verdict(failed: Column, policy: str = "default") -> Column:
    """True for a document that no rule of the policy rejects."""
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = "default") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that are kept without it.

    The documents are first counted by mask, at most 2^rules rows whatever the
    size of the corpus.
    """
    named = POLICIES[policy]
    whole = mask(named)
    by_mask = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).cast("long").alias("bit")) for name in named])).alias("r")
    each = by_mask.select("failed", "n", rules).select("failed", "n", "r.rule", "r.bit")
    within = F.col("failed").bitwiseAND(F.lit(whole).cast("long"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0)("failing"),
        count(within == F.col("bit"))("failing_alone"),
        count(within.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdicts of the base and default policies."""
    entries = ledger(common.table(spark, sf_dir, "documents"))
    failed = F.col("failed")
    base = ~verdict(failed, "base")
    return entries.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & verdict(failed)).alias("kept"), failed.alias("failed_rules"))


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << r} ELSE 0 END" for r, (_, rule) in enumerate(RULES))
OP5_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), starts AS (
  SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW}
), grams AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM starts
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, range({WINDOW}) AS r(j) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
  FROM t LEFT JOIN covered USING (rid)
), f AS (SELECT *, ({_BITS})::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_rules & {mask(BASE)}) <> 0 AS base_failed,
  (failed_rules & {mask(POLICIES["default"])}) = 0 AS kept, failed_rules
FROM f
"""

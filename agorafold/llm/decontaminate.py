"""Benchmark decontamination with DataFrame functions only.

Words are the maximal runs of ASCII letters (lower-cased), ASCII digits and
non-ASCII characters.  A test window is ``WINDOW`` consecutive words of a
benchmark item, or the whole of a shorter item.  A document word is hit if an
occurrence of a test window covers it.

The hash set of test n-grams is broadcast and training text is scanned for it:

1. scan: a test window of n words, wherever it lies, contains a whole block of
   b words that starts at a multiple of n - b + 1 words.  So it is enough to
   look up the document's b-grams at every (n - b + 1)-th word in the set of
   all b-grams of the test windows, and a document without a find has no hit.
   Test windows of unlike lengths are scanned for each length.
2. verify: documents with a find look up the hashes of all their windows, and
   the words of those that are found are compared with the test windows' words.
   Hashes travel without words, and no row holds more than three numbers a
   window of its text.

A set is broadcast only if its rows, which are counted first, take at most
``BROADCAST_BYTES``; a larger one is joined by shuffling the look-ups.

Defined results: a null or empty text has no words, no hits and is clean; a
null or empty benchmark item has no windows; a null item_id is an item
without a name and isn't listed; items that repeat an item_id count once; a
null doc_id is treated as an id; repeated rows give repeated, equal results;
empty tables give no rows, or no hits; other columns pass through and internal
ones start with ``__dc_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.llm import common

WINDOW = 10
BROADCAST_BYTES = 48 << 20
#: A broadcast row of a hash, and of a window's words and item.
HASH_BYTES, GRAM_BYTES = 24, 320
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words as they are written.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def block_of(length: int) -> tuple[int, int]:
    """(words of a block, step between blocks) with which any window of ``length`` words holds a whole block."""
    block = (length + 1) // 2
    return block, length - block + 1


def _words_at(words: str, i: str, n: int) -> str:
    """SQL for n words from position i (from 0) on; taken one by one, as slice() copies the whole array each time."""
    return ", ".join(f"get({words}, {i} + {k})" for k in range(n))


def _starts(words: str, n: int, step: int = 1) -> str:
    """SQL for the array of positions (from 0) at which n words start."""
    last = f"size({words}) - {n}"
    return f"case when {last} >= 0 then sequence(0, {last}, {step}) else cast(array() as array<int>) end"


def _hashes(words: str, n: int, step: int = 1) -> str:
    """SQL for the array of 64-bit hashes of n-grams; n is hashed too, so that sizes don't mix."""
    return f"transform({_starts(words, n, step)}, i -> xxhash64({n}, {_words_at(words, 'i', n)}))"


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, gram): the distinct windows of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.withColumn("n", F.least(F.size("w"), F.lit(window)))
    grams = f"case when n < {window} then array(w) else transform({_starts('w', window)}, i -> array({_words_at('w', 'i', window)})) end"
    return items.select("item_id", "n", F.explode(F.expr(grams)).alias("gram")).distinct()


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast what has been counted to be small; join anything else by shuffling."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__dc_id, __dc_text, at, n, item_id): the occurrences of test windows in documents.

    One row per document row key, position, window length and item;
    (__dc_id, __dc_text) = doc_id and a hash of the text.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "decontaminate")
    tests = scratch.keep(test_windows(benchmark, window))
    lengths = [r[0] for r in tests.select("n").distinct().orderBy("n").collect()]  # at most `window` numbers
    keyed = docs.select(F.col("doc_id").alias("__dc_id"), F.xxhash64("text").alias("__dc_text"), F.col("text").alias("__dc_t"))
    if not lengths:
        return keyed.where(F.lit(False)).select("__dc_id", "__dc_text", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("item_id"))

    # Scan.
    blocks = [tests.where(F.col("n") == n).select(F.explode(F.expr(_hashes("gram", block_of(n)[0]))).alias("h")) for n in lengths]
    known = blocks[0]
    for more in blocks[1:]:
        known = known.unionByName(more)
    known = _small(scratch.keep(known.distinct()), HASH_BYTES)
    probes = ", ".join(_hashes("w", *block_of(n)) for n in lengths)
    scanned = keyed.withColumn("w", words_of(F.col("__dc_t"))).select("__dc_id", "__dc_text", F.explode(F.expr(f"array_distinct(concat({probes}))")).alias("h"))
    found = scanned.join(known, "h", "left_semi")
    suspects = scratch.keep(found.select(F.col("__dc_id").alias("__dc_i"), F.col("__dc_text").alias("__dc_x")).distinct())

    # Verify. All windows of the suspects, by hash and then by the words.
    same = F.col("__dc_id").eqNullSafe(F.col("__dc_i")) & (F.col("__dc_text") == F.col("__dc_x"))
    texts = keyed.join(suspects, same, "left_semi").dropDuplicates(["__dc_id", "__dc_text"]).select("__dc_id", "__dc_text", words_of(F.col("__dc_t")).alias("w"))
    every = ", ".join(f"transform({_starts('w', n)}, i -> named_struct('n', {n}, 'at', i, 'h', xxhash64({n}, {_words_at('w', 'i', n)})))" for n in lengths)
    windows = texts.select("__dc_id", "__dc_text", F.explode(F.expr(f"concat({every})")).alias("g")).select("__dc_id", "__dc_text", "g.*")
    whole = " ".join(f"when {n} then xxhash64({n}, {_words_at('gram', '0', n)})" for n in lengths)
    hashes = scratch.keep(tests.select(F.expr(f"case n {whole} end").alias("h")).distinct())
    near = windows.join(_small(hashes, HASH_BYTES), "h", "left_semi").groupBy("__dc_id", "__dc_text").agg(F.collect_list(F.struct("n", "at")).alias("spots"))
    near = near.select(F.col("__dc_id").alias("__dc_i"), F.col("__dc_text").alias("__dc_x"), "spots")
    spots = texts.join(near, same).select("__dc_id", "__dc_text", "w", F.explode("spots").alias("s"))
    grams = spots.select("__dc_id", "__dc_text", F.col("s.n").alias("n"), F.col("s.at").alias("at"), F.expr("slice(w, s.at + 1, s.n)").alias("gram"))
    wanted = tests.select("item_id", F.col("n").alias("tn"), F.col("gram").alias("tgram"))
    hits = grams.join(_small(wanted, GRAM_BYTES), (F.col("n") == F.col("tn")) & (F.col("gram") == F.col("tgram")))
    return hits.select("__dc_id", "__dc_text", "at", "n", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with __dc_words (long), __dc_hit (array of hit word positions) and __dc_items (array of item ids, sorted).

    docs: doc_id, text and any other columns.
    """
    hits = find_hits(docs, benchmark, window)
    per = hits.groupBy("__dc_id", "__dc_text").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("__dc_items"))
    positions = F.expr("array_sort(array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.n - 1)))))")
    per = per.select(F.col("__dc_id").alias("__dc_i"), F.col("__dc_text").alias("__dc_x"), positions.alias("__dc_hit"), "__dc_items")
    out = docs.withColumns({"__dc_words": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long"), "__dc_text": F.xxhash64("text")})
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col("__dc_i")) & (F.col("__dc_text") == F.col("__dc_x")), "left").drop("__dc_i", "__dc_x", "__dc_text")
    return out.withColumns({"__dc_hit": F.coalesce("__dc_hit", F.expr("cast(array() as array<int>)")), "__dc_items": F.coalesce("__dc_items", F.expr("cast(array() as array<string>)"))})


def remove_documents(marked: DataFrame) -> DataFrame:
    """The documents without a hit, without the marks."""
    return marked.where(F.size("__dc_hit") == 0).drop("__dc_words", "__dc_hit", "__dc_items")


def remove_spans(marked: DataFrame) -> DataFrame:
    """All documents; hit words and what stands between two of them are cut from the texts."""
    # Word k of the text is preceded by gap k; gaps and words alternate.
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = marked.withColumns({"__dc_w": F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), "__dc_g": F.split(text, WORD_ANY_CASE, -1)})
    kept = F.expr("""concat(array_join(transform(__dc_w, (x, i) -> case
        when array_contains(__dc_hit, i) and array_contains(__dc_hit, i - 1) then ''
        when array_contains(__dc_hit, i) then __dc_g[i]
        else concat(__dc_g[i], x) end), ''), element_at(__dc_g, -1))""")
    return pieces.withColumn("text", F.when(F.size("__dc_hit") > 0, kept).otherwise(F.col("text"))).drop("__dc_w", "__dc_g", "__dc_words", "__dc_hit", "__dc_items")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents against the whole benchmark."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    n_hit, items = F.size("__dc_hit").cast("long"), F.col("__dc_items")
    return marked.select(
        "doc_id", F.col("__dc_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_DUCK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_DUCK_WORDS} AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), tests AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), lengths AS (SELECT DISTINCT n FROM tests),
starts AS (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n
), grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts
), hits AS (
  SELECT rid, i, n, item_id FROM grams JOIN tests USING (n, g)
), spots AS (
  SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT rid, i, unnest(range(n)) AS j FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN named USING (rid)
"""

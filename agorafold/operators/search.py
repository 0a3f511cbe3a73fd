"""Full-text search: BM25 over whole texts, and the query language.

A query is a list of clauses: words, "phrases", ``+`` must, ``-`` must not and
``field:term``.  An open quote runs to the end; clauses without a sign must
all match unless the caller asks for any.  ``scan`` answers a query from the
texts, ``text_index`` from an inverted index, with the same scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.functions import text as text_functions
from agorafold.operators import paging
from agorafold.sources import oplog, sinks, tables

K1, B = 1.2, 0.75
QUERY = ("pathetic", "idiot", "scum")
_CLAUSE = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)(?:"|$)|(\S+))')


@dataclass(frozen=True)
class Clause:
    words: tuple[str, ...]
    sign: str = ""
    field: str | None = None


def parse(query: str) -> list[Clause]:
    """The clauses of a query; those without a letter or digit are left out."""
    found = []
    for sign, field, phrase, word in _CLAUSE.findall(query):
        words = tuple(re.findall(r"[a-z0-9]+", (phrase or word).lower()))
        if words:
            found.append(Clause(words, sign, field or None))
    return found


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def matches(clause: Clause, fields: dict[str, Column]) -> Column:
    """True where one of the fields (or the named one) has the clause's words in a row."""
    chosen = [fields[clause.field]] if clause.field in fields else list(fields.values())
    wanted = f" {' '.join(clause.words)} "
    found = F.lit(False)
    for column in chosen:
        found = found | F.contains(F.concat(F.lit(" "), F.array_join(words_of(column), " "), F.lit(" ")), F.lit(wanted))
    return found


def predicate(query: str, fields: dict[str, Column], every: bool = True) -> Column:
    """The condition of a whole query."""
    clauses = parse(query)
    out, some = F.lit(True), None
    for clause in clauses:
        hit = matches(clause, fields)
        if clause.sign == "-":
            out = out & ~hit
        elif clause.sign == "+" or every:
            out = out & hit
        else:
            some = hit if some is None else some | hit
    return out if some is None else out & some


#: Fields that a clause without a field looks in, all scored; and fields that only a clause naming them looks in, unscored.
FIELDS, KEYWORDS = ("title", "body"), ("lang",)


def searched(clause: Clause) -> tuple[str, ...]:
    """The fields that a clause looks in; an unknown field name means any."""
    return (clause.field,) if clause.field in FIELDS + KEYWORDS else FIELDS


def count_name(i: int, field: str) -> str:
    """Column of how often a field has clause i."""
    return f"n{i}_{field}"


def wanted(clauses: list[Clause]) -> Column:
    """Documents that a whole query finds, from its clauses' counts: all but the excluded clauses, and at least one of those."""
    hits = [F.greatest(*[F.col(count_name(i, f)) for f in searched(c)], F.lit(0)) > 0 for i, c in enumerate(clauses)]
    out = F.lit(any(c.sign != "-" for c in clauses))
    for clause, hit in zip(clauses, hits, strict=True):
        out = out & (~hit if clause.sign == "-" else hit)
    return out


def rarity(total, found):
    """Of a word that ``found`` of ``total`` documents have."""
    return F.log(1 + (total - found + 0.5) / (found + 0.5))


def saturated(n, length, average):
    """What n occurrences in a field of a length count."""
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / average))


def score(clauses: list[Clause], frequency, total, average) -> Column:
    """BM25 summed over the clauses that aren't excluded and their scored fields.

    A phrase counts as one word as rare as its words together.  frequency:
    (word, field) -> documents; average: field -> mean length; the rest are
    columns or numbers, and lengths are the columns ``length_<field>``.
    """
    out = F.lit(0.0)
    for i, clause in enumerate(clauses):
        for field in searched(clause):
            if clause.sign == "-" or field not in FIELDS:
                continue
            weight = sum((rarity(total, frequency(w, field)) for w in clause.words[1:]), rarity(total, frequency(clause.words[0], field)))
            n = F.col(count_name(i, field))
            out = out + F.when(n > 0, weight * saturated(n, F.col(f"length_{field}"), average(field))).otherwise(0.0)
    return F.round(out, 6)


def in_a_row(words: Column, wanted_words: tuple[str, ...]) -> Column:
    """How often an array has some words in a row."""

    def at(word: Column, i: Column) -> Column:
        here = word == wanted_words[0]
        for k, w in enumerate(wanted_words[1:], 1):
            here = here & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
        return here

    return F.size(F.filter(words, at))


def document_fields(docs: DataFrame) -> DataFrame:
    """(id, title, body, lang, source): the first line is a document's title, the whole text its body."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), F.substring_index(text, "\n", 1).alias("title"), text.alias("body"), F.coalesce("lang", F.lit("")).alias("lang"), "source")


def scan(docs: DataFrame, query: str) -> DataFrame:
    """(id, source, score) of the documents that a whole query finds, by reading all of them.

    Each document becomes one row with its lengths and counts, so that words are
    never shuffled; document frequencies and average lengths are one row.  Texts
    are read and divided into words once: the rows are kept for both uses.
    """
    clauses = parse(query)
    fields = FIELDS + KEYWORDS
    pairs = sorted({(w, f) for c in clauses for w in c.words for f in searched(c) if f in FIELDS and c.sign != "-"})
    known = {p: f"has{i}" for i, p in enumerate(pairs)}
    words = oplog.parsed(docs, ["id", "source"], *[words_of(F.col(f)).alias(f) for f in fields])
    counted = oplog.parsed(
        words, ["id", "source"], *[F.size(f).alias(f"length_{f}") for f in FIELDS], *[in_a_row(F.col(f), c.words).alias(count_name(i, f)) for i, c in enumerate(clauses) for f in searched(c)],
        *[F.array_contains(f, w).alias(name) for (w, f), name in known.items()],
    )
    counted = sinks.Shared(docs.sparkSession, "search").keep(counted)  # some numbers a document
    sums = [F.count_if(name).alias(f"d_{name}") for name in known.values()]
    whole = counted.agg(F.count("*").alias("total"), *[F.avg(f"length_{f}").alias(f"average_{f}") for f in FIELDS], *sums)
    found = counted.where(wanted(clauses)).crossJoin(F.broadcast(whole))  # one row
    return found.select("id", "source", score(clauses, lambda w, f: F.col(f"d_{known[w, f]}"), F.col("total"), lambda f: F.col(f"average_{f}")).alias("score"))


def _equal(term: str):
    return lambda word: word == F.lit(term)


def _scored(docs: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(id, score) of the documents of (id, text) that have any of some terms.

    Each document becomes one row with its length and the terms' counts, so the
    words themselves are never shuffled; document frequencies and the average
    length are one row.
    """
    words = words_of(F.col("text"))
    counted = docs.select("id", words.alias("w")).select("id", F.size("w").alias("length"), *[F.size(F.filter("w", _equal(t))).alias(f"n{i}") for i, t in enumerate(terms)])
    whole = counted.agg(F.count("*").alias("total"), F.avg("length").alias("average"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    scored = counted.crossJoin(F.broadcast(whole))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        total = total + rarity(F.col("total"), F.col(f"d{i}")) * saturated(F.col(f"n{i}"), F.col("length"), F.col("average"))
    return scored.select("id", F.round(total, 6).alias("score")).where("score > 0")


def bm25(docs: DataFrame, terms: tuple[str, ...], limit: int = 20) -> DataFrame:
    """The best documents of (id, text) for some terms."""
    return paging.top(_scored(docs, terms), "score", limit)


def find_text(spark: SparkSession, sf_dir: str, query: str = "pathetic scum", author: str | None = None, sort: str = "relevance", last: int | None = None, limit: int = 20, without: tuple[str, ...] = ()) -> DataFrame:
    """Documents that a query finds, by relevance or the newest first, after a document.

    author: of one source only; without: not of these sources.  Frequencies are
    those of all documents.
    """
    rows = scan(document_fields(tables.read(spark, sf_dir, "documents")), query)
    rows = rows if author is None else rows.where(F.col("source") == author)
    rows = rows.where(~F.col("source").isin(*without)) if without else rows
    rows = rows.withColumn("rank_by", F.col("score") if sort == "relevance" else F.col("id").cast("double"))
    return paging.page(rows, "rank_by", last, limit).select("id", "score")


#: Registered searches: a query, and what else is asked; their SQL is made from the same clauses in another way (plans.oracles).
SEARCHES = {
    "search_minus": {"query": "scum -idiot"},
    "search_plus": {"query": "+the en +of"},
    "search_phrase": {"query": '"of the" is'},
    "search_field": {"query": 'title:the body:"in the" lang:en'},
    "search_open_quote": {"query": '-idiot lang:en "and the'},
    "search_newest": {"query": "the of", "sort": "created", "without": ("src0", "src1")},
    "search_author": {"query": "the in", "author": "src2"},
}


def searches() -> dict:
    """Each of ``SEARCHES`` as a query: its first page."""
    return {name: (lambda spark, sf_dir, asked=asked: find_text(spark, sf_dir, **asked)) for name, asked in SEARCHES.items()}


def search_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search by relevance, after the last row of the first."""
    rows = scan(document_fields(tables.read(spark, sf_dir, "documents")), "the of")
    bound = paging.top(rows, "score").orderBy("score", "id").limit(1)
    return paging.top(paging.after(rows, "score", bound), "score").select("id", "score")


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25(docs, QUERY)


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that match a query with a must, a must-not and a field clause."""
    docs = tables.read(spark, sf_dir, "documents")
    fields = {"body": F.col("text"), "lang": F.col("lang")}
    return docs.where(predicate("+the -idiot lang:en", fields)).select("doc_id")


def tag_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All space-separated words of each document as tags: how many, and a digest of the sorted list."""
    found = text_functions.tags(F.split(F.coalesce("text", F.lit("")), " "))
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.array_sort(found).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tags"), F.md5(F.array_join("t", ",").cast("binary")).alias("tags_md5"))

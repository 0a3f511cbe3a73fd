"""An inverted index with positions, kept by batch, and top-k search by bounds of blocks.

Tables below a folder, divided into versions, one a batch; those with terms also
into ``BUCKETS`` buckets of the term:

========  =====================================================================
postings  field, term, docs, words, heads, places: of the batch's documents; a row a term for each slice of some 4 MB of text
terms     field, term, docs, words: by how much the documents with the term and its occurrences have grown
blocks    field, term, block, most, least: most occurrences and least length in a block of 2^BLOCK_BITS ids; a block may have several rows
totals    field, documents, words: by how much they have grown
gone      id: documents of earlier batches that the batch replaces or deletes
docs      the rows of the batch, deletions too
========  =====================================================================

heads are packed numbers, three a document: id less the one before, length of the
field, occurrences; places are positions, each less the one before in the
document.  They are unpacked for the terms of a query only.

A batch adds segments and reads no postings: what it takes back of term counts
and totals comes from the replaced documents themselves.  Texts are written once
and don't move between tasks, unless a batch has an id twice or replaces more
than ``BROADCAST_ROWS`` documents.  A posting or document counts unless a later
version names it as gone.  ``compact`` writes the live
rows as an index of one segment.  A batch that is run again replaces its own
version, so a retry changes nothing.

A search reads the buckets of its terms only.  Blocks of ids are bounded: no
document of a block can have more than the sum over clauses of the scores of
its most occurrences in its shortest field.  The best few blocks give the k-th
score so far; of the others those with a higher bound are read.

Documents are rows (id, title, body, lang, deleted), one an id in a batch (of
several the greatest row counts); null texts are empty, rows without an id are
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.operators import paging, search
from agorafold.sources import sinks, tables

DOCS = "id long, title string, body string, lang string"
CHANGES = f"{DOCS}, deleted boolean"
POSTINGS = "field string, term string, docs int, words int, heads binary, places binary"
EACH = "field string, term string, version int, id long, length int, positions array<int>"
TERMS = "field string, term string, docs long"
BLOCKS = "field string, term string, block long, most int, least int"
TOTALS = "field string, documents long, words long"
GONE = "id long"
BLOCK_BITS = 12
#: Fixed for the life of an index; within a bucket files are sorted by term.
BUCKETS = 32
#: Blocks that give the first bound, and rows out of gone documents or blocks that are broadcast.
PROBE, BROADCAST_ROWS = 8, 500_000
#: Ids of a batch that are looked up by the statistics of the files of documents.
FEW = 100
#: Bytes of text whose postings a task makes at once, or one text.
SLICE_BYTES = 1 << 22
#: Rows of postings that are unpacked at once; each is of one slice.
OPENED = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_FIELDS = search.FIELDS + search.KEYWORDS


def _block(id: Column) -> Column:
    return F.shiftright(id, BLOCK_BITS)


def _term_bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[a-z0-9]+`` of lower-cased texts in order, and the text of each."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _LETTER[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    start[cut] = inside[cut]
    letters = data[inside]
    ends = np.append(np.flatnonzero(start[inside]), len(letters)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(letters)), np.searchsorted(offsets, np.flatnonzero(start), "right") - 1


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before; the first of each run as it is."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[first] = values[first]
    return out


def _summed(steps: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of ``_steps``."""
    upto = np.cumsum(steps)
    return upto - np.repeat(upto[first] - steps[first], sizes)


def _signless(x: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small ones without."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _interleaved(*columns: np.ndarray) -> np.ndarray:
    return np.stack([c.astype(np.uint64) for c in columns], 1).ravel()


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of numbers, each in as few groups of seven bits as it needs; the last byte of a number is below 128."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        sizes += more
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[at[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(sizes[some] > k + 1, np.uint64(128), np.uint64(0))
    ends = np.append(at[first], len(out)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


def _unpacked(packed: pa.Array) -> np.ndarray:
    """All numbers of an array of runs."""
    data = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    last = data < 128
    end = np.flatnonzero(last)
    first = np.append(0, end[:-1] + 1)[: len(end)]
    digit = np.arange(len(data)) - np.repeat(first, end - first + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * digit).astype(np.uint64), first) if len(end) else np.zeros(0, np.uint64)


def _heads(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, length, occurrences) of each posting of some rows."""
    docs = batch.column("docs").to_numpy().astype(np.int64)
    steps, lengths, sizes = _unpacked(batch.column("heads")).reshape(-1, 3).T
    ids = (steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64)
    return np.repeat(np.arange(len(docs)), docs), _summed(ids, np.cumsum(docs) - docs, docs), lengths.astype(np.int64), sizes.astype(np.int64)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a few of the terms as one row a posting."""
    for whole in batches:
        for low in range(0, whole.num_rows, OPENED):
            batch = whole.slice(low, OPENED)
            row, ids, lengths, sizes = _heads(batch)
            ends = np.append(0, np.cumsum(sizes))
            places = _summed(_unpacked(batch.column("places")).astype(np.int64), ends[:-1], sizes)
            same = [batch.column(c).take(pa.array(row)) for c in ("field", "term", "version")]
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*same, pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), positions], names=["field", "term", "version", "id", "length", "positions"])


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other way round, for rows (field, term, list of (id, length, positions))."""
    for whole in batches:
        for low in range(0, whole.num_rows, OPENED):
            batch = whole.slice(low, OPENED)
            lists = batch.column("list")
            docs, each = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
            ids, lengths, positions = (each.field(i) for i in range(3))
            first, sizes = np.cumsum(docs) - docs, positions.value_lengths().to_numpy().astype(np.int64)
            posting = np.cumsum(sizes) - sizes
            heads = _interleaved(_signless(_steps(ids.to_numpy(), first)), lengths.to_numpy(), sizes)
            places = _steps(positions.flatten().to_numpy().astype(np.int64), posting).astype(np.uint64)
            columns = [batch.column("field"), batch.column("term"), pa.array(docs, pa.int32()), pa.array(np.add.reduceat(sizes, first) if len(first) else sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, _packed(heads, 3 * first), _packed(places, posting[first])], names=["field", "term", "docs", "words", "heads", "places"])


def _lists(field: str, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """A row for each term of some texts."""
    words, doc = _words(texts)
    n, known = len(words), words.dictionary_encode()
    codes, lengths = known.indices.to_numpy(), np.bincount(doc, minlength=len(ids))
    place = np.arange(n) - (np.cumsum(lengths) - lengths)[doc]
    order = np.argsort(codes, kind="stable")
    codes, doc = codes[order], doc[order]
    term = np.append(True, codes[1:] != codes[:-1])[:n]
    posting = np.flatnonzero(term | np.append(True, doc[1:] != doc[:-1])[:n])
    first = np.flatnonzero(term[posting])
    sizes = np.diff(np.append(posting, n))
    heads = _interleaved(_signless(_steps(ids[doc[posting]], first)), lengths[doc[posting]], sizes)
    docs, occurrences = (np.diff(np.append(x, end)) for x, end in ((first, len(posting)), (posting[first], n)))
    terms = known.dictionary.take(pa.array(codes[posting[first]])).cast(pa.string())
    columns = [pa.array([field] * len(first), pa.string()), terms, pa.array(docs, pa.int32()), pa.array(occurrences, pa.int32()), _packed(heads, 3 * first), _packed(_steps(place[order], posting).astype(np.uint64), posting[first])]
    return pa.RecordBatch.from_arrays(columns, names=["field", "term", "docs", "words", "heads", "places"])


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (id, lower-cased field texts)."""
    for batch in batches:
        size, low = np.zeros(batch.num_rows + 1, np.int64), 0
        for texts in batch.columns[1:]:
            size[1:] += np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(size, size[low] + SLICE_BYTES, "right")) - 1)
            some = batch.slice(low, high - low)
            for field, texts in zip(_FIELDS, some.columns[1:], strict=True):
                yield _lists(field, some.column(0).to_numpy(), texts)
            low = high


def postings(docs: DataFrame) -> DataFrame:
    return docs.select("id", *[F.lower(f).alias(f) for f in _FIELDS]).mapInArrow(_read_texts, POSTINGS)


def _write(rows: DataFrame, root: str, name: str, version: int, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(*by).parquet(f"{root}/{name}/version={version}")


def _write_buckets(rows: DataFrame, order: list[str], root: str, name: str, version: int) -> None:
    """By bucket of the term, sorted, so that a term is found by the files' statistics."""
    placed = rows.withColumn("bucket", _term_bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
    _write(placed, root, name, version, "bucket")


def _read(spark: SparkSession, root: str, name: str, schema: str, version: int, buckets: set[int] | None = None) -> DataFrame:
    """Rows of all versions up to one, with ``version``; of some buckets of the term."""
    pattern = f"{root}/{name}/version=*" + ("/bucket=*" if buckets is not None else "")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    paths = []
    for status in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        path = status.getPath().toString()
        parts = dict(p.split("=") for p in path.split("/") if re.fullmatch(r"(version|bucket)=\d+", p))
        if int(parts["version"]) <= version and (buckets is None or int(parts["bucket"]) in buckets):
            paths.append(path)
    whole = schema + ", version int" + (", bucket int" if buckets is not None else "")
    return spark.read.schema(whole).option("basePath", f"{root}/{name}").parquet(*paths) if paths else spark.createDataFrame([], whole)


def _small(rows: DataFrame) -> DataFrame:
    """For a broadcast where few rows have been counted, else as it is."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _written(spark: SparkSession, root: str, name: str, schema: str, version: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{name}/version={version}")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["field", "term", "block", "bucket"]
    for batch in batches:
        row, ids, lengths, sizes = _heads(batch)
        change = np.append(True, (row[1:] != row[:-1]) | (ids[1:] >> BLOCK_BITS != ids[:-1] >> BLOCK_BITS))[: len(row)]
        at = np.flatnonzero(change)
        if len(at):
            same = [batch.column(c).take(pa.array(row[at])) for c in ("field", "term", "bucket")]
            runs = pa.Table.from_arrays([*same, pa.array(ids[at] >> BLOCK_BITS), pa.array(np.maximum.reduceat(sizes, at)), pa.array(np.minimum.reduceat(lengths, at))], names=["field", "term", "bucket", "block", "most", "least"])
            found = runs.group_by(names, use_threads=False).aggregate([("most", "max"), ("least", "min")])
            kinds = pa.schema([("field", pa.string()), ("term", pa.string()), ("block", pa.int64()), ("most", pa.int32()), ("least", pa.int32()), ("bucket", pa.int32())])
            yield from found.select(["field", "term", "block", "most_max", "least_min", "bucket"]).rename_columns(kinds.names).cast(kinds).to_batches()


def _write_postings(rows: DataFrame, root: str, version: int) -> None:
    """Postings and the bounds of their blocks; the second are worked out where the first lie, term by term."""
    _write_buckets(rows, ["term", "field"], root, "postings", version)
    heads = _written(rows.sparkSession, root, "postings", POSTINGS + ", bucket int", version).select("bucket", "field", "term", "docs", "heads")
    _write(heads.mapInArrow(_bounds, BLOCKS + ", bucket int").sortWithinPartitions("bucket", "term", "field", "block"), root, "blocks", version, "bucket")


def _batch(changes: DataFrame, root: str, version: int) -> DataFrame:
    """The rows of a batch, one an id, as its version keeps them."""
    spark = changes.sparkSession
    columns = [F.col("id").cast("long").alias("id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in _FIELDS], F.coalesce("deleted", F.lit(False)).alias("deleted")]
    _write(changes.where("id is not null").select(*columns), root, "docs", version)
    batch = _written(spark, root, "docs", CHANGES, version)
    if batch.groupBy("id").count().where("count > 1").isEmpty():
        return batch
    shared = sinks.Shared(spark, "text-index")
    single = shared.keep(batch.groupBy("id").agg(F.max(F.struct(*_FIELDS, "deleted")).alias("r")).select("id", "r.*"))
    _write(single, root, "docs", version)
    shared.drop(single)
    return _written(spark, root, "docs", CHANGES, version)


def _standing(spark: SparkSession, root: str, version: int, ids: DataFrame | None = None) -> DataFrame:
    """The documents as they stand at a version, all or of some ids."""
    rows = _read(spark, root, "docs", CHANGES, version)
    if ids is not None:
        few = [r["id"] for r in ids.limit(FEW + 1).collect()]
        rows = (rows.where(F.col("id").isin(few)) if len(few) <= FEW else rows).join(_small(ids), "id", "left_semi")
    return _live(rows, root, version).where("not deleted").select("id", *_FIELDS)


def index_batch(changes: DataFrame, root: str, version: int) -> None:
    """The next version of an index: new, changed and deleted documents. Versions count from 1."""
    spark = changes.sparkSession
    batch = _batch(changes, root, version)
    shared = sinks.Shared(spark, "text-index")
    old = shared.keep(_standing(spark, root, version - 1, batch.select("id")))
    new = batch.where("not deleted")

    _write_postings(postings(new), root, version)
    added = _written(spark, root, "postings", POSTINGS, version).select("field", "term", "docs", "words")
    lost = postings(old).select("field", "term", (-F.col("docs")).alias("docs"), (-F.col("words")).alias("words"))
    grown = added.unionByName(lost).groupBy("field", "term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    _write_buckets(grown.where("docs <> 0 or words <> 0"), ["term", "field"], root, "terms", version)
    documents = new.count() - old.count()
    fields = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in _FIELDS])).alias("field"))
    words = _written(spark, root, "terms", TERMS + ", words long", version).groupBy("field").agg(F.sum("words").alias("words"))  # a row a field
    _write(fields.join(F.broadcast(words), "field", "left").select("field", F.lit(documents).cast("long").alias("documents"), F.coalesce("words", F.lit(0)).cast("long").alias("words")), root, "totals", version)
    _write(old.select("id"), root, "gone", version)
    shared.drop(old)


def _live(rows: DataFrame, root: str, version: int) -> DataFrame:
    """Postings whose document no later version names as gone."""
    gone = _read(rows.sparkSession, root, "gone", GONE, version).groupBy(F.col("id").alias("__g")).agg(F.max("version").alias("__v"))
    return rows.join(_small(gone), F.col("id") == F.col("__g"), "left").where(F.col("__v").isNull() | (F.col("version") >= F.col("__v"))).drop("__g", "__v")


def _each(lists: DataFrame) -> DataFrame:
    """A row for each posting."""
    return lists.select("field", "term", "version", "docs", "heads", "places").mapInArrow(_opened, EACH)


def compact(spark: SparkSession, root: str, version: int, target: str) -> None:
    """The index of a version as one segment in another folder."""
    buckets = set(range(BUCKETS))
    live = _live(_each(_read(spark, root, "postings", POSTINGS, version, buckets)), root, version)
    lists = live.groupBy("field", "term", _block(F.col("id"))).agg(F.array_sort(F.collect_list(F.struct("id", "length", "positions"))).alias("list"))
    _write_postings(lists.select("field", "term", "list").mapInArrow(_repacked, POSTINGS), target, version)
    _write_buckets(term_counts(spark, root, version), ["term", "field"], target, "terms", version)
    _write(totals(spark, root, version), target, "totals", version)
    _write(spark.createDataFrame([], GONE), target, "gone", version)
    _write(_standing(spark, root, version).withColumn("deleted", F.lit(False)), target, "docs", version)


def term_counts(spark: SparkSession, root: str, version: int, buckets: set[int] | None = None) -> DataFrame:
    """(field, term, docs): how many documents have each term."""
    rows = _read(spark, root, "terms", TERMS, version, set(range(BUCKETS)) if buckets is None else buckets)
    return rows.groupBy("field", "term").agg(F.sum("docs").alias("docs")).where("docs > 0")


def totals(spark: SparkSession, root: str, version: int) -> DataFrame:
    return _read(spark, root, "totals", TOTALS, version).groupBy("field").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"))


def _less(k: int):
    return lambda place: place - F.lit(k)


class Search:
    """One query over an index: (id, score) of what it finds, with the scores of ``search.scan``."""

    def __init__(self, spark: SparkSession, root: str, version: int, query: str):
        self.spark, self.root, self.version, self.clauses = spark, root, version, search.parse(query)
        self.pairs = sorted({(w, f) for c in self.clauses for w in c.words for f in search.searched(c)})
        words = sorted({w for w, _ in self.pairs})
        rows = spark.createDataFrame([(w,) for w in words], "term string").select(_term_bucket(F.col("term")).alias("b")).distinct()
        self.buckets = {r["b"] for r in rows.collect()}  # a number a word of the query
        known = totals(spark, root, version).collect()  # a row a field
        self.documents = max([0, *(r["documents"] for r in known)])
        self.average = {r["field"]: r["words"] / max(1, r["documents"]) or 1.0 for r in known}
        self.counts = {(r["term"], r["field"]): r["docs"] for r in self._of_terms(term_counts(spark, root, version, self.buckets)).collect()}  # a row a word and field

    def _of_terms(self, rows: DataFrame) -> DataFrame:
        """Of the rows of the buckets those of the query's words; the filter reaches the files."""
        some = F.lit(False)
        for field in sorted({f for _, f in self.pairs}):
            some = some | ((F.col("field") == field) & F.col("term").isin([w for w, f in self.pairs if f == field]))
        return rows.where(some)

    def _postings(self) -> DataFrame:
        return _each(self._of_terms(_read(self.spark, self.root, "postings", POSTINGS, self.version, self.buckets)))

    def _matches(self, rows: DataFrame) -> DataFrame:
        """(id, score) of the documents of some postings that the whole query finds; phrases by positions."""
        one = lambda value, word, field: F.max(F.when((F.col("term") == word) & (F.col("field") == field), F.col(value)))
        places = {p: f"p{i}" for i, p in enumerate(self.pairs)}
        lengths = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("length"))), F.lit(0)).alias(f"length_{f}") for f in search.FIELDS]
        each = _live(rows, self.root, self.version).groupBy("id").agg(*lengths, *[one("positions", *p).alias(name) for p, name in places.items()])

        def times(clause: search.Clause, field: str) -> Column:
            first, *more = (F.col(places[w, field]) for w in clause.words)
            for k, later in enumerate(more, 1):
                first = F.array_intersect(first, F.transform(later, _less(k)))
            return F.when(first.isNotNull(), F.size(first)).otherwise(0)

        counted = each.select("id", *[f"length_{f}" for f in search.FIELDS], *[times(c, f).alias(search.count_name(i, f)) for i, c in enumerate(self.clauses) for f in search.searched(c)])
        score = search.score(self.clauses, lambda w, f: F.lit(self.counts.get((w, f), 0)), F.lit(self.documents), lambda f: F.lit(self.average.get(f, 1.0)))
        return counted.where(search.wanted(self.clauses)).select("id", score.alias("score"))

    def bounds(self) -> DataFrame:
        """(version, block, bound) of the blocks that can have a document of the query."""
        rows = self._of_terms(_read(self.spark, self.root, "blocks", BLOCKS, self.version, self.buckets))
        asked = [(i, c) for i, c in enumerate(self.clauses) if c.sign != "-"]
        names = {p: (f"m{i}", f"l{i}") for i, p in enumerate(self.pairs)}
        one = lambda value, word, field, best: best(F.when((F.col("term") == word) & (F.col("field") == field), F.col(value)))
        per = rows.groupBy("version", "block").agg(*[x for p, (m, n) in names.items() for x in (one("most", *p, F.max).alias(m), one("least", *p, F.min).alias(n))])
        bound, there = F.lit(0.0), F.lit(bool(asked))
        for _, clause in asked:
            has = F.lit(False)
            for field in search.searched(clause):
                every = F.lit(True)
                best, weight = None, F.lit(0.0)
                for w in clause.words:
                    most, least = (F.col(n) for n in names[w, field])
                    every = every & most.isNotNull()
                    part = search.saturated(most, least, F.lit(self.average.get(field, 1.0)))
                    best = part if best is None else F.least(best, part)
                    weight = weight + search.rarity(F.lit(self.documents), F.lit(self.counts.get((w, field), 0)))
                has = has | every
                bound = bound + (F.when(every, weight * best).otherwise(0.0) if field in search.FIELDS else F.lit(0.0))
            there = there & has
        return per.where(there).select("version", "block", bound.alias("bound"))

    def found(self) -> DataFrame:
        """(id, score) of all that the query finds."""
        return self._matches(self._postings())

    def page(self, limit: int = 20, last: int | None = None) -> DataFrame:
        """The best documents, or the best after one of them."""
        rows, after = self._postings(), F.lit(True)
        if last is not None:
            behind = self._matches(rows.where(F.col("id") == last)).first()
            if behind is not None:
                after = (F.col("score") < behind["score"]) | ((F.col("score") == behind["score"]) & (F.col("id") < last))
        bounds = self.bounds()
        probe = bounds.orderBy(F.desc("bound"), F.desc("version"), F.desc("block")).limit(PROBE).collect()
        some = F.lit(False)
        for r in probe:
            low = r["block"] << BLOCK_BITS
            some = some | ((F.col("version") == r["version"]) & F.col("id").between(low, low + (1 << BLOCK_BITS) - 1))
        best = paging.top(self._matches(rows.where(some)).where(after), "score", limit).collect() if probe else []  # ``limit`` rows
        if len(best) == limit:
            bounds = bounds.where(F.col("bound") >= best[-1]["score"] - 1e-6)  # scores are rounded
        chosen = _small(bounds.select(F.col("version").alias("__v"), F.col("block").alias("__b")))
        rows = rows.join(chosen, (F.col("version") == F.col("__v")) & (_block(F.col("id")) == F.col("__b")), "left_semi")
        return paging.top(self._matches(rows).where(after), "score", limit)


QUERY = '+the "in the" -idiot lang:en'


def _built(spark: SparkSession, sf_dir: str) -> str:
    """An index of all documents in two batches: the first has other texts for a quarter, the second replaces them."""
    root = f"{sinks.Shared(spark, 'index').open()}/index"
    docs = search.document_fields(tables.read(spark, sf_dir, "documents")).withColumn("deleted", F.lit(False))
    changed = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    index_batch(docs.withColumn("body", F.when(changed, F.concat(F.lit("idiot the in the "), F.reverse("body"))).otherwise(F.col("body"))), root, 1)
    index_batch(docs.where(changed), root, 2)
    return root


def text_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a query, from an index of all documents."""
    return Search(spark, _built(spark, sf_dir), 2, QUERY).page()


def text_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each term of each field, kept over two batches."""
    return term_counts(spark, _built(spark, sf_dir), 2)

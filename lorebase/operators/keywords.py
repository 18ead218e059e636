"""Keyword search: a kept inverted index with stems, and exact BM25 top k by upper bounds.

Words are runs of letters and digits of any script, lower-cased, without diacritics, and stemmed by Porter's rules. The index is a
folder of tables: postings has, by bucket of the term, blocks of BLOCK documents in the order of what the term gives them, with
the largest of it; terms has each term's number of documents and largest gift; documents each one's terms. A term in very many documents is dealt
over lists of about LIST documents, in rows of ROW documents, so no task sorts more.

A query reads the buckets of its terms only; see pruned for the blocks that it opens, and search for what it scores. Queries
that are whole texts ask for most terms, so bounds spare them little; search_all scores many of these together, with the
documents passing by them in packed blocks.
"""

from __future__ import annotations

import re
import unicodedata
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.sources.shared import cut

#: Buckets of an index unless told otherwise, documents of a block, and of a list.
BUCKETS, BLOCK, LIST = 16, 128, 1 << 16
#: A posting where many of them move as one value: for a rare term that is shorter than two arrays.
ENTRY = np.dtype([("id", "<i8"), ("gift", "<f8")])
#: Words or postings that a task takes together, and documents of a row that moves to its list.
PIECE, ROW = 1 << 19, 512
#: In search_all, documents of a block and queries of a group, postings of either, and postings and scores that are added up at once.
PART, GROUP, MOST, SCORED = 1 << 12, 1 << 11, 1 << 20, 1 << 20
#: Terms in one of so many documents of a block are multiplied as a matrix, this many at most.
DENSE, WIDE = 16, 1024
#: Bytes of a batch that passes to Python, of which either side holds several, and the setting that says so.
BATCH, BATCH_BYTES = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Weak terms may add this share of the bound: with more of them fewer blocks are opened, but more documents must be scored.
WEAK = 0.5

# Porter's suffixes with what replaces them, by step.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Over words in which y is Y where it is a consonant.
VOWEL, MORE, MORE_2 = "[aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
SHORT_END, DOUBLE = "[^aeiouy][aeiouy][^aeiouywxY]$", "(?:" + "|".join(2 * c for c in "bcdfghjkmnpqrtvwx") + ")$"


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Porter's stem of a folded word; words of one or two letters, or of over 64 bytes, stay."""
    if len(word) < 3 or len(word.encode()) > 64:
        return word
    has = lambda pattern, text: re.search(pattern, text) is not None
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if has(MORE, w[:-3]) else w
    elif w.endswith(("ed", "ing")):
        cut = w[: -2 if w.endswith("ed") else -3]
        if has(VOWEL, cut):
            w = cut + "e" if cut.endswith(("at", "bl", "iz")) or (not has(DOUBLE, cut) and has(MORE, cut) and not has(MORE_2, cut) and has(SHORT_END, cut)) else cut[:-1] if has(DOUBLE, cut) else cut
    if w.endswith(("y", "Y")) and has(VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        for suffix, instead in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                w = w[: -len(suffix)] + instead if has(MORE, w[: -len(suffix)]) else w
                break
    for suffix in sorted(STEP_4, key=lambda s: -len(s)):
        if w.endswith(suffix):
            cut = w[: -len(suffix)]
            w = cut if has(MORE_2, cut) and (suffix != "ion" or cut.endswith(("s", "t"))) else w
            break
    if w.endswith("e"):
        cut = w[:-1]
        w = cut if has(MORE_2, cut) or (has(MORE, cut) and not has(SHORT_END, cut)) else w
    if w.endswith("ll") and has(MORE_2, w[:-1]):
        w = w[:-1]
    return w.lower()


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Letters that are a letter and marks, and these letters; the marks alone, which go, come last."""
    pairs = []
    for code in range(0xC0, 0xFFFF):
        parts = unicodedata.normalize("NFD", chr(code)) if not 0xD800 <= code < 0xE000 else ""
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(p[0] for p in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(p[1] for p in pairs)


def words(text: Column) -> Column:
    """Folded words of a text, in order; null: none."""
    marked, plain = _folds()
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pieces(lists: pa.ListArray):
    """(first, number) of rows in a row that hold at most PIECE entries together, or of one longer row."""
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    first = 0
    while first < len(lists):
        before = ends[first - 1] if first else 0
        n = max(1, int(np.searchsorted(ends, before + PIECE, "right")) - first)
        yield first, n
        first += n


def _counted(batches):
    """(id, number of words, stems, counts) of each document; each different word of a piece is stemmed once."""
    for batch in batches:
        for first, n in _pieces(batch.column(1)):
            own = batch.column(1).slice(first, n)
            lengths, found = own.value_lengths().to_numpy(), own.flatten().dictionary_encode()
            stems = pa.array([stem(w) for w in found.dictionary.to_pylist()], pa.string()).dictionary_encode()
            size = max(1, len(stems.dictionary))
            pairs, counts = np.unique(np.repeat(np.arange(n), lengths) * size + stems.indices.to_numpy()[found.indices.to_numpy()], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * size).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, stems.dictionary.take(pa.array(pairs % size)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(lengths.astype(np.int64)), terms, pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))], ["id", "length", "terms", "counts"])


def _listed(k1: float, b: float, mean: float):
    """From counted documents to rows (term, entries) of at most ROW documents each, so that postings move as lists."""

    def run(batches):
        for batch in batches:
            for first, n in _pieces(batch.column(2)):
                ids, length, terms, counts = (c.slice(first, n) for c in batch.columns)
                doc, found = np.repeat(np.arange(n), terms.value_lengths().to_numpy()), terms.flatten().dictionary_encode()
                code = found.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                code, doc, tf = code[order], doc[order], counts.flatten().to_numpy()[order]
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                begins = np.flatnonzero((np.arange(len(code)) - np.repeat(starts, np.diff(starts, append=len(code)))) % ROW == 0)
                entries = np.empty(len(code), ENTRY)
                entries["id"], entries["gift"] = ids.to_numpy()[doc], gift(tf.astype(float), length.to_numpy()[doc].astype(float), k1, b, mean)
                offsets = np.append(begins, len(code)).astype(np.int32) * ENTRY.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])
                yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(code[begins])), packed], ["term", "entries"])

    return run


def _blocks(batches):
    """Blocks of lists whose rows (term, list, entries) come together: within a list by falling gift, ties by id."""
    names = ["term", "list", "n", "most", "ids", "gifts"]

    def told(rows: pa.Table, starts: np.ndarray):
        packed = rows["entries"].combine_chunks()
        sizes = pa.compute.binary_length(packed).to_numpy() // ENTRY.itemsize
        lists = np.repeat(np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows))), sizes)
        first = np.frombuffer(packed.buffers()[1], np.int32, 1, 4 * packed.offset)[0]
        entries = np.frombuffer(packed.buffers()[2], ENTRY, int(sizes.sum()), int(first))
        ids, gifts = entries["id"], entries["gift"]
        order = np.lexsort((ids, -gifts, lists))
        ids, gifts, lists = ids[order], gifts[order], lists[order]
        firsts = np.searchsorted(lists, np.arange(len(starts)))
        begins = np.flatnonzero((np.arange(len(ids)) - firsts[lists]) % BLOCK == 0)
        offsets, at = pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(starts[lists[begins]])
        columns = [rows["term"].combine_chunks().take(at), rows["list"].combine_chunks().take(at), pa.array(np.diff(begins, append=len(ids))), pa.array(gifts[begins])]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(gifts))], names)

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not len(rows):
            continue
        term, part = rows["term"].combine_chunks(), rows["list"].to_numpy()
        same = pa.compute.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False).astype(bool) & (part[1:] == part[:-1])
        starts = np.flatnonzero(np.append(True, ~same))
        held = rows.slice(int(starts[-1]))  # the last list may go on
        if len(starts) > 1:
            yield told(rows.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
    if held is not None:
        yield told(held.combine_chunks(), np.zeros(1, np.int64))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


POSTINGS = "term string, list int, n long, most double, ids array<long>, gifts array<double>, bucket int"
TERMS = "term string, df long, most double, idf double, bucket int"
COUNTED = "id long, length long, terms array<string>, counts array<long>"
BLOCKS = "n long, words long, packed binary"


def gift(tf, length, k1: float, b: float, mean: float):
    """What a term adds to a document's score, without the term's idf: of columns or of arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _split(docs: DataFrame) -> DataFrame:
    return docs.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), words(F.col("text")).alias("words"))


def count_terms(docs: DataFrame) -> DataFrame:
    """The terms of docs (id, text) with their counts: COUNTED. Rows without an id are left out; a null text has no words."""
    return _split(docs).mapInArrow(_counted, COUNTED)


def _size(counted: DataFrame):
    return counted.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).first()


def write_index(docs: DataFrame, folder: str, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS) -> None:
    """Index of docs (id, text) as a new folder."""
    spark = docs.sparkSession
    count_terms(docs).write.parquet(f"{folder}/documents")
    counted = spark.read.schema(COUNTED).parquet(f"{folder}/documents")
    size = _size(counted)
    mean = size["mean"] or 1.0
    spark.createDataFrame([(size.n, mean, k1, b, buckets)], "n long, mean double, k1 double, b double, buckets int").write.json(f"{folder}/size")
    # Terms of more than one list are one at most for LIST postings of the table; written, so that their size tells how to join.
    hot = cut(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") > LIST).select("term", F.ceil(F.col("df") / LIST).cast("int").alias("lists")), "hot")
    rows = counted.mapInArrow(_listed(k1, b, mean), "term string, entries binary")
    dealt = rows.join(hot, "term", "left").select("term", F.pmod(F.xxhash64("entries"), F.coalesce("lists", F.lit(1))).cast("int").alias("list"), "entries")
    blocks = dealt.repartition("term", "list").sortWithinPartitions("term", "list").mapInArrow(_blocks, POSTINGS.removesuffix(", bucket int"))
    blocks.withColumn("bucket", bucket(F.col("term"), buckets)).write.partitionBy("bucket").parquet(f"{folder}/postings")
    idf = F.log((F.lit(size.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    terms.withColumn("idf", F.greatest(idf, F.lit(1e-6))).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")


@dataclass
class Index:
    """A written index: postings (blocks), terms (df, most, idf), documents (id, length, terms, counts)."""

    postings: DataFrame
    terms: DataFrame
    documents: DataFrame
    k1: float
    b: float
    mean: float
    buckets: int


def read_index(spark: SparkSession, folder: str) -> Index:
    size = spark.read.json(f"{folder}/size").first()
    return Index(spark.read.schema(POSTINGS).parquet(f"{folder}/postings"), spark.read.schema(TERMS).parquet(f"{folder}/terms"), spark.read.schema(COUNTED).parquet(f"{folder}/documents"), size.k1, size.b, size["mean"], size.buckets)


def _stemmed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted({stem(w) for w in own}) for own in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["query_id", "terms"])


def _terms_of(queries: DataFrame) -> DataFrame:
    own = queries.filter("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.filter(words(F.col("text")), lambda w: F.char_length(w) >= 2).alias("words"))
    return own.mapInArrow(_stemmed, "query_id long, terms array<string>")


def query_terms(queries: DataFrame, buckets: int) -> DataFrame:
    """(query_id, term, bucket) of queries (query_id, text): the different stems of words of two letters or more."""
    terms = _terms_of(queries).select("query_id", F.explode("terms").alias("term"))
    return terms.withColumn("bucket", bucket(F.col("term"), buckets))


def _parts(blocks: DataFrame) -> DataFrame:
    """(query_id, id, part) of every document of the blocks."""
    return blocks.select("query_id", "idf", F.explode(F.arrays_zip("ids", "gifts")).alias("p")).select("query_id", F.col("p.ids").alias("id"), (F.col("idf") * F.col("p.gifts")).alias("part"))


def _scored(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, id, bm25) of chosen (query_id, id) pairs, from the documents' own terms."""
    own = index.documents.join(pairs, "id").select("query_id", "id", "length", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    own = own.select("query_id", "id", F.col("t.terms").alias("term"), gift(F.col("t.counts"), F.col("length"), index.k1, index.b, index.mean).alias("gift"))
    return own.join(asked.select("query_id", "term", "idf"), ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("idf") * F.col("gift")).alias("bm25"))


def _first(scored: DataFrame, by: str, top: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), "id"))
    return scored.withColumn("n", order).filter(F.col("n") <= top)


def pruned(index: Index, queries: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(terms of the queries, blocks of these): opened tells which blocks can name a document of the first top.

    The first block of each term gives documents whose exact scores bound the top-th from below: least. Terms are taken from
    the weakest on while all they can add stays below that: a document with these alone is out, so they name none. A
    block of another term is opened if what it gives at most, with the most of all other terms, reaches the bound.
    """
    asked = query_terms(queries, index.buckets).join(index.terms, ["bucket", "term"]).withColumn("bound", F.col("idf") * F.col("most")).drop("most")
    asked = cut(asked, "asked")
    blocks = asked.join(index.postings, ["bucket", "term"])
    best = blocks.filter(F.col("list") == 0).withColumn("first", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("most"), "ids"))).filter("first = 1")
    # Written, so that their size tells whether the documents must move to meet them.
    known = cut(_first(_parts(best).groupBy("query_id", "id").agg(F.sum("part").alias("least")), "least", top).select("query_id", "id"), "known")
    floor = _scored(index, asked, known).groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("bm25")).alias("least"))
    weakest = Window.partitionBy("query_id").orderBy("bound", "term")
    asked = asked.join(floor, "query_id", "left").withColumn("upto", F.sum("bound").over(weakest)).withColumn("others", F.sum("bound").over(Window.partitionBy("query_id")) - F.col("bound"))
    asked = asked.withColumn("weak", F.coalesce(F.col("upto") < WEAK * F.col("least") - 1e-6, F.lit(False)))
    asked = cut(asked.withColumn("weak_most", F.coalesce(F.sum(F.when(F.col("weak"), F.col("bound"))).over(Window.partitionBy("query_id")), F.lit(0.0))), "asked")
    opened = ~F.col("weak") & F.coalesce(F.col("idf") * F.col("most") + F.col("others") >= F.col("least") - 1e-6, F.lit(True))
    return asked, asked.join(index.postings, ["bucket", "term"]).withColumn("opened", opened)


def search(index: Index, queries: DataFrame, top: int) -> DataFrame:
    """query_id, id, bm25, score (best 1, worst 0, alone 1) of each query's best documents; ties at nine digits go to the smaller id.

    What the opened blocks give a document, with the most of the weak terms, must reach the bound. The first of these are scored
    whole, which raises the bound, and of the others only those that can reach that one are scored, each from its own
    terms: the weak terms' long lists are not opened. A strong block that stayed shut holds none of the first top.
    """
    asked, blocks = pruned(index, queries, top)
    weak = asked.groupBy("query_id").agg(F.max("weak_most").alias("weak_most"), F.max("least").alias("least"))
    able = lambda bound: F.coalesce(F.col("part") + F.col("weak_most") >= F.col(bound) - 1e-6, F.lit(True))
    some = _parts(blocks.filter("opened")).groupBy("query_id", "id").agg(F.sum("part").alias("part")).join(weak, "query_id")
    some = cut(some.filter(able("least")).select("query_id", "id", "part", "weak_most"), "able")
    best = cut(_first(some, "part", top).select("query_id", "id"), "best")
    floor = _scored(index, asked, best).groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("bm25")).alias("floor"))
    last = cut(some.join(cut(floor, "floor"), "query_id", "left").filter(able("floor")).select("query_id", "id"), "last")
    return _with_score(_first(_scored(index, asked, last), "bm25", top).drop("n"))


def _with_score(scored: DataFrame) -> DataFrame:
    by = Window.partitionBy("query_id")
    spread = F.max("bm25").over(by) - F.min("bm25").over(by)
    return scored.withColumn("score", F.when(spread > 0, (F.col("bm25") - F.min("bm25").over(by)) / spread).otherwise(1.0))


def _packed(**columns: pa.Array) -> bytes:
    """Arrays of any lengths as the lists of one compressed row."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.BinaryScalar, *names: str) -> list[pa.Array]:
    row = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
    return [row.column(n).flatten() for n in names]


def _met(lists: pa.Array, rows: int, held: list[int]):
    """(first, number) of rows that come together into what holds held rows and entries: at most rows and MOST, or one longer row."""
    for first, n in _pieces(lists):
        for at in range(first, first + n, rows):
            many = min(rows, first + n - at)
            entries = int(pa.compute.sum(lists.slice(at, many).value_lengths()).as_py() or 0)
            if held[0] and (held[0] + many > rows or held[1] + entries > MOST):
                held[:] = 0, 0
            held[:] = held[0] + many, held[1] + entries
            yield at, many, held[0] == many


def _in_order(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms in order, for each entry its term's place there, and its row)."""
    found = lists.flatten().dictionary_encode()
    order = pa.compute.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return found.dictionary.take(order), place[found.indices.to_numpy()], np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _gathered(at: int, rows: int, told):
    """Rows of batches in packs of at most so many rows, or MOST entries of the list column at; told: from a pack's rows to a batch of one row."""

    def run(batches):
        pieces, held = [], [0, 0]
        for batch in batches:
            for first, n, anew in _met(batch.column(at), rows, held):
                if anew and pieces:
                    yield told(pa.Table.from_batches(pieces).combine_chunks())
                    pieces = []
                pieces.append(batch.slice(first, n))
        if pieces:
            yield told(pa.Table.from_batches(pieces).combine_chunks())

    return run


def _block(rows: pa.Table) -> pa.RecordBatch:
    """Counted documents by term: of every term, in order, its number of documents, and these with their counts."""
    terms, code, doc = _in_order(rows["terms"].combine_chunks())
    by_term = np.argsort(code, kind="stable")
    counts = rows["counts"].combine_chunks().flatten().to_numpy()[by_term]
    small = counts.astype(np.uint16) if counts.max(initial=0) < 1 << 16 else counts
    length = rows["length"].combine_chunks()
    packed = _packed(ids=rows["id"].combine_chunks(), length=length, terms=terms, df=pa.array(np.bincount(code, minlength=len(terms)).astype(np.int32)), doc=pa.array(doc[by_term].astype(np.uint16)), counts=pa.array(small))
    return pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([pa.compute.sum(length).as_py() or 0], pa.int64()), pa.array([packed], pa.binary())], ["n", "words", "packed"])


def _group(rows: pa.Table) -> pa.RecordBatch:
    """Queries: their terms, in order, and for each query the places of its own."""
    lists = rows["terms"].combine_chunks()
    terms, code, _ = _in_order(lists)
    packed = _packed(ids=rows["query_id"].combine_chunks(), sizes=pa.array(lists.value_lengths().to_numpy().astype(np.int32)), code=pa.array(code), terms=terms)
    return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["asked"])


def _frequencies(batches):
    """(term, df) of a block's terms."""
    for batch in batches:
        for packed in batch.column(0):
            terms, df = _unpacked(packed, "terms", "df")
            yield from _short(pa.RecordBatch.from_arrays([terms, df.cast(pa.int64())], ["term", "df"]))


def _vocabulary(batches):
    """(group, place, term) of a group's terms."""
    for batch in batches:
        for group, packed in zip(batch.column(0), batch.column(1), strict=True):
            (terms,) = _unpacked(packed, "terms")
            yield from _short(pa.RecordBatch.from_arrays([pa.repeat(group, len(terms)), pa.array(np.arange(len(terms), dtype=np.int32)), terms], ["group", "place", "term"]))


def _short(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, 1 << 14):
        yield batch.slice(at, 1 << 14)


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of n entries each."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


class _Block:
    """Documents with their postings by term, and what these give without the term's idf."""

    def __init__(self, packed: pa.BinaryScalar, k1: float, b: float, mean: float):
        ids, length, self.terms, df, doc, counts = _unpacked(packed, "ids", "length", "terms", "df", "doc", "counts")
        self.ids, self.df, self.doc = ids.to_numpy(), df.to_numpy().astype(np.int64), doc.to_numpy()
        self.begin = np.cumsum(self.df) - self.df
        self.gift = gift(counts.to_numpy().astype(float), length.to_numpy().astype(float)[self.doc], k1, b, mean)
        # By document, its terms in order: equal documents add up alike wherever they stand.
        self.by_doc = np.argsort(self.doc, kind="stable")
        self.code = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        self.size = np.bincount(self.doc, minlength=len(self.ids))
        self.first = np.cumsum(self.size) - self.size


class _Group:
    """Queries with the best documents that they have met."""

    def __init__(self, packed: pa.BinaryScalar, places: np.ndarray, idf: np.ndarray, top: int):
        ids, sizes, code, self.terms = _unpacked(packed, "ids", "sizes", "code", "terms")
        self.ids, self.sizes, self.code, self.top = ids.to_numpy(), sizes.to_numpy().astype(np.int64), code.to_numpy(), top
        self.idf = np.zeros(len(self.terms))
        self.idf[places] = idf
        self.query = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.found, self.best = np.zeros((len(self.ids), top), np.int64), np.full((len(self.ids), top), -np.inf)

    def meet(self, block: _Block) -> None:
        """All documents of a block are scored in single precision; those that may be among the first top are scored again, exactly."""
        n = len(block.ids)
        place = pa.compute.fill_null(pa.compute.index_in(self.terms, value_set=block.terms), -1).to_numpy()
        known = place >= 0
        weight = np.zeros(len(block.df))
        weight[place[known]] = self.idf[known]
        value = block.gift * weight[block.code]
        # Terms of many of the block's documents are rows of a matrix, the others are added by their postings.
        many = np.flatnonzero((block.df * DENSE >= n) & (weight > 0))
        many = many[np.argsort(-block.df[many], kind="stable")[:WIDE]]
        row = np.full(len(block.df) + 1, -1)
        row[many] = np.arange(len(many))
        at = _spans(block.begin[many], block.df[many])
        matrix = np.zeros((len(many), n), np.float32)
        matrix[np.repeat(np.arange(len(many)), block.df[many]), block.doc[at]] = value[at]
        code = place[self.code]
        own = code >= 0
        code, query = code[own], self.query[own]
        rare = row[code] < 0
        by_doc = block.code[block.by_doc], value[block.by_doc]
        cost = np.cumsum(n + np.bincount(query, np.where(rare, block.df[code], 0), len(self.ids)).astype(np.int64))
        ends = np.searchsorted(query, np.arange(len(self.ids) + 1))
        lo = 0
        while lo < len(self.ids):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + SCORED, "right")))
            part = slice(ends[lo], ends[hi])
            self._scored(block, lo, hi, code[part], query[part] - lo, row, rare[part], matrix, value, by_doc)
            lo = hi

    def _scored(self, block, lo: int, hi: int, code, query, row, rare, matrix, value, by_doc) -> None:
        n, top = len(block.ids), self.top
        held = np.zeros((hi - lo, len(matrix)), np.float32)
        held[query[~rare], row[code[~rare]]] = 1
        score = held @ matrix
        sizes = block.df[code[rare]]
        at = _spans(block.begin[code[rare]], sizes)
        score += np.bincount(block.doc[at] + np.repeat(query[rare] * n, sizes), value[at], (hi - lo) * n).reshape(hi - lo, n).astype(np.float32)
        # A sum of so many parts, none negative, is off by this share at most, here taken twice.
        slack = (self.sizes[lo:hi] + 8) * 2.0**-22
        least = np.maximum(self.best[lo:hi, -1] * (1 - slack) - 1e-8, 1e-30)
        near = score >= least[:, None].astype(np.float32)
        if len(crowded := np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * top)):
            kth = np.partition(score[crowded], n - top, axis=1)[:, n - top].astype(float)
            near[crowded] &= score[crowded] >= np.maximum(kth * (1 - 2 * slack[crowded]) - 1e-8, 1e-30)[:, None].astype(np.float32)
        who, doc = np.nonzero(near)
        if not len(who):
            return
        asked = np.zeros((hi - lo, len(block.df)), bool)
        asked[query, code] = True
        exact, ends, first = np.empty(len(who)), np.cumsum(block.size[doc]), 0
        while first < len(who):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
            sizes = block.size[doc[first:last]]
            at, pair = _spans(block.first[doc[first:last]], sizes), np.repeat(np.arange(last - first), sizes)
            exact[first:last] = np.bincount(pair, np.where(asked[who[first:last][pair], by_doc[0][at]], by_doc[1][at], 0.0), last - first)
            first = last
        ids, full = block.ids[doc], self.best[lo:hi] > -np.inf
        who, ids, exact = np.concatenate((np.nonzero(full)[0], who)), np.concatenate((self.found[lo:hi][full], ids)), np.concatenate((self.best[lo:hi][full], exact))
        order = np.lexsort((ids, -np.round(exact, 9), who))
        who, ids, exact = who[order], ids[order], exact[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < top
        self.found[lo + who[kept], rank[kept]], self.best[lo + who[kept], rank[kept]] = ids[kept], exact[kept]

    def answers(self) -> pa.RecordBatch:
        who, rank = np.nonzero(self.best > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[who]), pa.array(self.found[who, rank]), pa.array(self.best[who, rank])], ["query_id", "id", "bm25"])


def _answers(top: int, k1: float, b: float, mean: float):
    """From pairs (block, packed, group, asked, places, idf) to (query_id, id, bm25) of the best documents among the blocks that pass."""

    def run(batches):
        block, at, groups = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != at:
                    block, at = _Block(batch.column(1)[i], k1, b, mean), batch.column(0)[i].as_py()
                if (group := batch.column(2)[i].as_py()) not in groups:
                    groups[group] = _Group(batch.column(3)[i], batch.column(4)[i].values.to_numpy(), batch.column(5)[i].values.to_numpy(), top)
                groups[group].meet(block)
        for group in groups.values():
            yield from _short(group.answers())

    return run


def search_all(counted: DataFrame, queries: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """What search gives, for many long queries (query_id, text) over counted documents (see count_terms)."""
    return search_blocks(counted.mapInArrow(_gathered(2, PART, _block), BLOCKS), queries, top, k1, b)


def count_blocks(docs: DataFrame) -> DataFrame:
    """The terms of docs (id, text), as count_terms counts them, in packed blocks: BLOCKS. One Python process makes both."""
    packed = _gathered(2, PART, _block)
    return _split(docs).mapInArrow(lambda batches: packed(_counted(batches)), BLOCKS)


@contextmanager
def short_batches(spark: SparkSession):
    """What runs within passes to Python in batches of few blocks; the setting is put back."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def search_blocks(blocks: DataFrame, queries: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """What search gives, for many long queries (query_id, text) over blocks of documents (see count_blocks).

    Blocks of at most PART documents are written, queries are packed into groups of at most GROUP. A task holds a group and what it has found, and
    blocks pass it: they are read again for each group, and neither side is copied or shuffled for the other. Work grows with queries
    times documents, the disk with documents, and with queries times the tasks that share the blocks, which are as few as keep the cores busy.
    """
    spark = blocks.sparkSession
    with short_batches(spark):
        blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("n")).alias("mean")).first()
        listed = cut(_terms_of(queries).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")), "listed")
        groups = listed.coalesce(max(1, -(-listed.count() // GROUP))).mapInArrow(_gathered(1, GROUP, _group), "asked binary")
        groups = cut(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
        df = blocks.select("packed").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.greatest(F.log((F.lit(size.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        known = groups.select("group", "asked").mapInArrow(_vocabulary, "group long, place int, term string").join(df, "term").groupBy("group").agg(F.collect_list(F.struct("place", idf.alias("idf"))).alias("t"))
        asked = cut(groups.join(known.select("group", F.col("t.place").alias("places"), F.col("t.idf").alias("idf")), "group"), "asked")
        many = max(1, asked.count())
        blocks = blocks.select("block", "packed").coalesce(max(1, -(-2 * spark.sparkContext.defaultParallelism // many)))
        met = blocks.crossJoin(asked.repartitionByRange(many, "group").select("group", "asked", "places", "idf").hint("shuffle_replicate_nl"))
        found = cut(met.mapInArrow(_answers(top, k1, b, size["mean"] or 1.0), "query_id long, id long, bm25 double"), "found")
    return _with_score(_first(found, "bm25", top).drop("n"))

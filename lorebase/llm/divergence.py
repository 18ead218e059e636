"""Audit of how far the sources of a language differ in their words, by single-pass in-memory indexing.

1. Every task counts the words of its texts in memory, per language and source, and the documents of each word per
   language. Whenever BLOCK_ENTRIES words are held, the block is spilled as a run: its terms in sorted order, dealt over
   shards by a hash of the term, cut into segments of bounded size.
2. A shard's task merges the runs with a heap. Segments come in the order of their first term, so that only those are open
   that the merge has reached. With more than FAN_IN runs they are merged in rounds of FAN_IN into longer runs.
3. Of the kept terms' frequencies, the divergence of two sources is what it would be if neither had any of them, corrected
   for each distinct frequency of the one and of the other, and for the terms that both have. Only these last need the
   terms themselves; they stream through a task that keeps sums per pair of sources.

All numbers are exact integers, up to 9e15 words a language. A document's words are counted
whole before they are posted, so runs only need to be added; a text is cut into pieces of bounded size where no word is.

Defined results: null text, language or source is the empty text, and its group is one like any other. A language whose
words are all rare keeps none: its pairs have the value 0 and it has no terms. Repeated rows and ids are rows of their own,
as ids are not read. An empty table gives no rows. Ties go by the item's UTF-8 bytes. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import PASS_BYTES, Scratch, passes

#: Words held by a task before it spills a run, and runs that a shard's task merges at once.
BLOCK_ENTRIES, FAN_IN = 400_000, 256
#: Entries and bytes of terms in a segment at most; a longer term is a segment of its own.
SEGMENT_ENTRIES, SEGMENT_BYTES = 512, 1 << 15
#: Sources of a term whose pairs one row tells, pairs that are summed at once, and sums that a task holds.
SIDE, PAIRS, DENSE = 1024, 1 << 19, 1 << 21
#: A posting counts its documents in units of this.
DOC = 1 << 40
ONE = 1_000_000_000
RUN = "shard int, run long, lang string, term binary, segment binary"
#: Letters and all bytes of other scripts stay, A-Z as a-z; the rest are spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes):
    """The words of a text, in lists of about PASS_BYTES."""
    text, lo = text.translate(WORDS), 0
    while lo < len(text):
        hi = lo + PASS_BYTES
        hi = len(text) if hi >= len(text) else text.find(b" ", hi)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def _segments(shard: int, run: int, lang: str, entries):
    """Rows of a run: entries are (term, documents, {source: count}) in the order of their terms."""
    part, size = [], 0
    for entry in entries:
        if part and (len(part) == SEGMENT_ENTRIES or size + len(entry[0]) + 16 * len(entry[2]) > SEGMENT_BYTES):
            yield shard, run, lang, part[0][0], zlib.compress(pickle.dumps(part), 1)
            part, size = [], 0
        part.append(entry)
        size += len(entry[0]) + 16 * len(entry[2])
    if part:
        yield shard, run, lang, part[0][0], zlib.compress(pickle.dumps(part), 1)


def _batches(rows, schema: pa.Schema, many: int = 256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_RUN_SCHEMA = pa.schema([("shard", pa.int32()), ("run", pa.int64()), ("lang", pa.string()), ("term", pa.binary()), ("segment", pa.binary())])


def _index(shards: int, most: int):
    """Blocks of postings in memory, spilled as runs whenever they hold most entries.

    A posting is one number, the count and DOC times the documents: small, so that a block of many fits in a worker.
    """

    def spill(blocks, run):
        for lang, own in groupby(sorted(blocks), key=lambda key: key[0]):
            postings, documents = defaultdict(dict), Counter()
            for key in own:
                for term, n in blocks[key].items():
                    postings[term][key[1]] = n % DOC
                    documents[term] += n // DOC
            dealt = defaultdict(list)
            for term in sorted(postings):
                dealt[zlib.crc32(term) % shards].append((term, documents[term], postings[term]))
            for shard, entries in dealt.items():
                yield from _segments(shard, run, lang, entries)

    def rows(batches):
        run = TaskContext.get().partitionId() << 32
        blocks, held = {}, 0
        for batch in passes(batches, "text"):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block, words = blocks.setdefault((lang, source), {}), Counter()
                for piece in _pieces(text):
                    words.update(piece)
                get, held = block.get, held - len(block)
                for term, n in words.items():
                    block[term] = get(term, 0) + n + DOC
                held += len(block)
                if held >= most:
                    yield from spill(blocks, run)
                    blocks, held, run = {}, 0, run + 1
        yield from spill(blocks, run)

    return lambda batches: _batches(rows(batches), _RUN_SCHEMA)


def _merged(segments):
    """(term, documents, {source: count}) in order, from a language's (first term, segment) rows in order."""
    heap: list = []

    def until(limit):
        while heap and (limit is None or heap[0][0] < limit):
            term, number, at, entries = heap[0]
            docs, postings = entries[at][1:]
            while True:  # the term's further entries are on top of the heap, too
                at += 1
                if at < len(entries):
                    heapq.heapreplace(heap, (entries[at][0], number, at, entries))
                else:
                    heapq.heappop(heap)
                if not heap or heap[0][0] != term:
                    break
                _, number, at, entries = heap[0]
                docs += entries[at][1]
                for source, n in entries[at][2].items():
                    postings[source] = postings.get(source, 0) + n
            yield term, docs, postings

    for number, (term, segment) in enumerate(segments):
        yield from until(term)
        heapq.heappush(heap, (term, number, 0, pickle.loads(zlib.decompress(segment))))
    yield from until(None)


def _streams(batches):
    """(shard, run, lang, its (term, segment) rows) for rows sorted by these."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:3]):
        yield *key, (row[3:] for row in group)


def _longer_runs(batches):
    return _batches((s for shard, run, lang, rows in _streams(batches) for s in _segments(shard, run, lang, _merged(rows))), _RUN_SCHEMA)


def _frequencies(least: int):
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n_docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        rows = ((lang, term, docs, list(postings), list(postings.values())) for _, _, lang, stream in _streams(batches) for term, docs, postings in _merged(stream) if docs >= least)
        return _batches(rows, schema, 2048)

    return run


def _group(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def frequencies(docs: DataFrame, scratch: Scratch, least: int = 3, block: int | None = None, fan_in: int | None = None) -> DataFrame:
    """(lang, term, n_docs, sources, counts) of the terms that at least so many documents of their language hold."""
    block, fan_in = block or BLOCK_ENTRIES, fan_in or FAN_IN
    shards = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = scratch.cut(_group(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(_index(shards, block), RUN), "runs")
    while (n := runs.select("run").distinct().count()) > fan_in:
        groups = runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(-(-n // fan_in) if n > fan_in * 2 else 2)))
        longer = scratch.cut(groups.repartition(shards, "shard", "run").sortWithinPartitions("shard", "run", "lang", "term").mapInArrow(_longer_runs, RUN), "runs")
        scratch.free(runs)
        runs = longer
    met = runs.withColumn("run", F.lit(0).cast("long")).repartition(shards, "shard").sortWithinPartitions("shard", "lang", "term")
    out = scratch.cut(met.mapInArrow(_frequencies(least), "lang string, term binary, n_docs long, sources array<string>, counts array<long>").withColumn("term", F.col("term").cast("string")), "frequencies")
    scratch.free(runs)
    return out


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (count + 1) / (total + terms)), a thousand at a time so that nothing overflows."""
    of, left, out = F.nullif(total + terms, F.lit(0)), count + 1, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + F.call_function("div", left, of)
        left = left % of
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(most: int, pairs: int, matrix: int):
    """Sums per pair of groups of what their common terms add; a row is a term's groups, p, p without the term, and which most of them are told here.

    Each batch's sums are told in pairs, summed in a matrix where that has at most so many cells.
    """

    def f(p, q):
        return (p - q) * (p - q) // q

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            group, p, p0 = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            sizes = pa.compute.list_value_length(batch.column(0)).to_numpy().astype(np.int64)
            ends, side = np.cumsum(sizes), batch.column(3).to_numpy().astype(np.int64) * most
            told = np.minimum(sizes - side, most)
            left = np.arange(told.sum()) + np.repeat(ends - sizes + side - np.cumsum(told) + told, told)
            start, many = np.repeat(ends - sizes, told), np.repeat(sizes, told)
            names, code = np.unique(group, return_inverse=True)
            dense = np.zeros(len(names) ** 2, np.int64) if len(names) ** 2 <= matrix else None
            upto, lo = np.cumsum(many), 0
            while lo < len(left):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + pairs, "right")))
                n = many[lo:hi]
                a = np.repeat(left[lo:hi], n)
                b = np.arange(len(a)) + np.repeat(start[lo:hi] - np.cumsum(n) + n, n)
                a, b = a[a != b], b[a != b]
                value, key = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]), code[a] * len(names) + code[b]
                if dense is not None:
                    np.add.at(dense, key, value)
                else:
                    keys, back = np.unique(key, return_inverse=True)
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, back, value)
                    yield pa.RecordBatch.from_arrays([pa.array(names[keys // len(names)]), pa.array(names[keys % len(names)]), pa.array(sums)], ["a", "b", "value"])
                lo = hi
            if dense is not None:
                keys = np.flatnonzero(dense)
                yield pa.RecordBatch.from_arrays([pa.array(names[keys // len(names)]), pa.array(names[keys % len(names)]), pa.array(dense[keys])], ["a", "b", "value"])

    return run


def audit(docs: DataFrame, least: int = 3, top: int = 200, block: int | None = None, fan_in: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: of every source its distance from each other one of its language (part pair), and
    its top most telling terms against the whole language (part term)."""
    scratch = Scratch(docs.sparkSession)
    kept = frequencies(docs, scratch, least, block, fan_in)
    posts = kept.withColumn("posting", F.explode(F.arrays_zip("sources", "counts"))).select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.col("posting.sources").alias("source"), F.col("posting.counts").alias("n"))
    langs = posts.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    groups = _group(docs).select("lang", "source").distinct().join(posts.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "lang_n", "v"]).withColumn("p0", share(F.lit(0).cast("long"), F.col("group_n"), F.col("v"))).withColumn("number", F.monotonically_increasing_id())
    groups = scratch.cut(groups, "groups")
    posts = posts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    q = share(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = posts.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    same = posts.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "p0")).alias("s")).filter(F.size("s") > 1)
    same = same.select("s.number", "s.p", "s.p0", F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / SIDE).cast("int"))).alias("side"))
    common = same.mapInArrow(_pair_sums(SIDE, PAIRS, DENSE), "a long, b long, value long")
    spread = posts.groupBy("lang", "number", "p", "p0").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("number").alias("other"), F.col("p0").alias("other_p0"))
    # The result names every pair of a language's sources; each of a source's frequencies meets each other source once.
    met = spread.join(other, "lang").filter("number <> other")
    own = met.select(F.col("number").alias("a"), F.col("other").alias("b"), (F.col("n") * (distance(F.col("p"), F.col("other_p0")) - distance(F.col("p0"), F.col("other_p0")))).alias("value"))
    theirs = met.select(F.col("other").alias("a"), F.col("number").alias("b"), (F.col("n") * (distance(F.col("other_p0"), F.col("p")) - distance(F.col("other_p0"), F.col("p0")))).alias("value"))
    wide = F.col("value").cast("decimal(38,0)")
    change = common.union(own).union(theirs).groupBy("a", "b").agg(F.sum(wide).alias("change"))
    left, right = groups.select("lang", "source", "v", F.col("number").alias("a"), F.col("p0").alias("p0")), other.join(groups.select(F.col("number").alias("other"), F.col("source").alias("item")), "other").withColumnRenamed("other", "b")
    pairs = left.join(right, "lang").filter("a <> b").join(change, ["a", "b"], "left")
    base = F.coalesce(F.col("v") * distance(F.col("p0"), F.col("other_p0")), F.lit(0)).cast("decimal(38,0)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("change", F.lit(0).cast("decimal(38,0)"))).cast("long").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return terms.withColumn("rank", rank).filter(F.col("rank") <= top).unionByName(pairs.withColumn("rank", rank))

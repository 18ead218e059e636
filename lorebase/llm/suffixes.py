"""Removal of repeated passages with two-stage suffix sorting.

A window is a string of `length` bytes. Every window lies in the group of the least hash of its GRAM-byte
parts, so equal windows meet without any document meeting another. Consecutive windows of a group form a
segment; equal segments, told by 64 bits of digest within their group, are counted, map-side first, and all windows of a segment that stands twice are
repeated. Where a group holds different segments, or one that may repeat itself, its segments are sorted:
only suffixes smaller than their successors are sorted directly, the others are induced by scanning the
buckets of the sorted ones, and adjacent common prefixes show the windows that stand twice.

A group of many different segments (a passage in very many documents) is dealt out by where in the
window its least part lies, which equal windows share, so it is not one task's.

Texts are moved only where they are cut: to sort their segments, and to take runs out of them.

Defined results: a null text is empty. Texts shorter than a window keep all bytes. Repeated rows (of equal id and
text, or of no id) count as different places, so they are removed, in each row. A null id is an id of its own. Extra
columns are ignored; without_repeats keeps them, and a null text without runs stays null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import U64, Scratch, Sieve, mix, passes, text_buffer

LENGTH = 400
GRAM = 32
#: Different segments of a group that one task sorts whole; bytes that are sorted together.
MANY, BLOCK = 512, 1 << 18
_R = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_NO_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position."""
    n = len(data) - GRAM + 1
    x = data.astype(U64) + U64(1)
    power, width = _R, 1
    while width < GRAM:  # the hash of 2, 4, ... bytes from that of 1, 2, ...
        x = x[:-width] * U64(power) + x[width:]
        power, width = power * power % (1 << 64), 2 * width
    return mix(x[:n])


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    out, have = h, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, length: int):
    """(first windows, counts, group keys, whether it may repeat itself) of one document's segments."""
    h = gram_hashes(data)
    width = length - GRAM + 1
    low = least(h, width)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = np.diff(first, append=len(low))
    again = np.array([np.count_nonzero(h[a : a + n + width - 1] == low[a]) > 1 for a, n in zip(first.tolist(), count.tolist(), strict=True)], bool)
    return first, count, low[first].view(np.int64), again


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Wanted positions of text in the order of their suffixes, which count to `depth` bytes at least.

    text: numbers from 1, with 0 after each segment. Two-stage sorting: a suffix smaller than its
    successor is sorted directly, any other is induced from its successor.
    """
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    after = np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)
    at = differs[after]
    direct = text[at] < text[np.minimum(at + 1, n - 1)]
    direct |= text == 0
    # Each wanted suffix needs its successors down to the first one that is sorted directly.
    stops = np.flatnonzero(direct)
    need = np.zeros(n + 1, np.int64)
    np.add.at(need, wanted, 1)
    np.add.at(need, stops[np.searchsorted(stops, wanted)] + 1, -1)
    need = np.cumsum(need[:-1]) > 0
    own = np.flatnonzero(need & direct)
    raw = (np.maximum(text, 1) - 1).astype(np.uint8).tobytes()
    ends = np.flatnonzero(text == 0)
    stop = ends[np.searchsorted(ends, own)]
    part = [raw[a : min(a + depth, b)] for a, b in zip(own.tolist(), stop.tolist(), strict=True)]
    own = own[sorted(range(len(own)), key=part.__getitem__)]
    del part
    induced = need & ~direct
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    byte = text[own]
    edges = np.searchsorted(np.sort(byte, kind="stable"), np.arange(258))
    # Equal first bytes are neighbours, but an empty suffix (0) sorts with its text's start.
    own = own[np.argsort(byte, kind="stable")]
    out = []
    for c in range(257):
        sorted_part = own[edges[c] : edges[c + 1]]
        todo, done = waiting[c], []
        while todo:  # induced suffixes of this bucket come before its direct ones, and can induce in it
            now = np.concatenate(todo)
            done.append(now)
            todo = _induce(text, induced, now, waiting, c)
        if len(sorted_part):
            done.append(sorted_part)
            todo = _induce(text, induced, sorted_part, waiting, c)
            assert not todo
        if done:
            out.append(np.concatenate(done))
    return np.concatenate(out) if out else own


def _induce(text, induced, scanned, waiting, c) -> list:
    """Put the induced predecessors of scanned suffixes into their buckets; returns those of bucket c."""
    before = scanned[scanned > 0] - 1
    before = before[induced[before]]
    same = []
    if len(before):
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(before, cuts):
            b = int(text[part[0]])
            if b == c:
                same.append(part)
            else:
                waiting[b].append(part)
    return same


def repeated(parts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each part, its windows (numbers below its count) that stand twice among all parts."""
    sizes = np.array([len(p) + 1 for p in parts])
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
    text[starts + sizes - 1] = 0
    counts = np.array(counts)
    wanted = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    order = suffix_order(text, wanted, length)
    is_wanted = np.zeros(len(text), bool)
    is_wanted[wanted] = True
    order = order[is_wanted[order]]
    raw = (np.maximum(text, 1) - 1).astype(np.uint8).tobytes()
    lcp = np.array([raw[a : a + length] == raw[b : b + length] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)], bool)
    twice = np.zeros(len(text), bool)
    twice[order[:-1][lcp]] = True
    twice[order[1:][lcp]] = True
    return [np.flatnonzero(twice[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]


def intervals(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers, both ends included."""
    if not len(numbers):
        return []
    cuts = np.flatnonzero(np.diff(numbers) > 1)
    return list(zip(numbers[np.concatenate(([0], cuts + 1))].tolist(), numbers[np.concatenate((cuts, [len(numbers) - 1]))].tolist(), strict=True))


def _segments(length: int):
    def run(batches):
        for batch in passes(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            parts = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                if len(own) >= length:
                    first, count, key, again = segments(own, length)
                    raw = own.tobytes()
                    digest = [int.from_bytes(hashlib.blake2b(raw[a : a + n + length - 1], digest_size=8).digest(), "little", signed=True) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                    parts.append((i, first, count, key, again, digest))
            if parts:
                index = pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]))
                first, count, key, again = (np.concatenate([p[j] for p in parts]) for j in range(1, 5))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(index), batch.column("mark").take(index), pa.array(key), pa.array([d for p in parts for d in p[5]], pa.int64()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)], ["id", "mark", "key", "digest", "first", "n", "again"])

    return run


def _cut_out(length: int):
    """Bytes of the segments to sort; a large group's are dealt out by the place of the least part."""
    width = length - GRAM + 1

    def run(batches):
        for batch in passes(batches, "text"):
            rows = []
            data, offsets = text_buffer(batch.column("text"))
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                for w in wanted:
                    piece = own[w["first"] : w["first"] + w["n"] + length - 1]
                    if w["deals"] == 1:
                        rows.append((w["key"], 0, w["digest"], 0, w["n"], piece.tobytes()))
                        continue
                    h = gram_hashes(piece)
                    places = np.flatnonzero(h == h[:width].min())
                    windows = np.arange(w["n"])
                    deal = (places[np.searchsorted(places, windows)] - windows) * w["deals"] // width
                    cuts = np.flatnonzero(np.diff(deal)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), w["n"]], strict=True):
                        rows.append((w["key"], int(deal[a]), w["digest"], a, b - a, piece[a : b + length - 1].tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "deal", "digest", "first", "n", "bytes"])

    return run


def _sort(length: int):
    """Windows that stand twice in a group, as intervals of window numbers of their segments."""

    def found(rows):
        out = []
        for (key, digest, first), own in zip([r[:3] for r in rows], repeated([r[4] for r in rows], [r[3] for r in rows], length), strict=True):
            out += [(key, digest, first + a, first + b) for a, b in intervals(own)]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "digest", "lo", "hi"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for key, deal, digest, first, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, deal) != last and size >= BLOCK:  # groups stay whole; small ones are sorted together
                    yield from found(held)
                    held, size = [], 0
                last = key, deal
                held.append((key, digest, first, n, raw))
                size += len(raw)
        if held:
            yield from found(held)

    return run


def _gone(own: np.ndarray, runs: list, least_words: int) -> np.ndarray:
    """Which bytes of own the runs cover, of maximal runs with least_words words or parts of words at least."""
    change = np.zeros(len(own) + 1, np.int32)
    np.add.at(change, [r["lo"] for r in runs], 1)
    np.add.at(change, [r["hi"] for r in runs], -1)
    gone = np.cumsum(change[:-1]) > 0
    if least_words > 1:
        for a, b in intervals(np.flatnonzero(gone)):
            inside = ~_SPACE[own[a : b + 1]]
            if int(inside[0]) + np.count_nonzero(inside[1:] & ~inside[:-1]) < least_words:
                gone[a : b + 1] = False
    return gone


def _remove(least_words: int):
    def run(batches):
        for batch in passes(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            n_bytes, removed, spans, kept = [], [], [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                gone = _gone(own, runs or [], least_words)
                n_bytes.append(len(own))
                removed.append(int(gone.sum()))
                spans.append(len(intervals(np.flatnonzero(gone))))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _strip(least_words: int, text_col: str):
    """(row, text without the runs); a null text where there are none."""

    def run(batches):
        for whole in batches:
            texts = pa.compute.struct_field(whole.column("row"), [text_col])
            with_text = pa.RecordBatch.from_arrays([whole.column("row"), texts, whole.column("runs")], ["row", "text", "runs"])
            for batch in passes([with_text], "text"):
                data, offsets = text_buffer(batch.column("text"))
                out = []
                for i, runs in enumerate(batch.column("runs").to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    out.append(None if runs is None else own[~_gone(own, runs, least_words)].tobytes().decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    return run


def _runs(rows: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(id, mark, runs) of the texts that have repeated bytes; rows: id, mark, text."""
    seen = scratch.cut(rows.mapInArrow(_segments(length), "id long, mark long, key long, digest long, first int, n int, again boolean"), "segments")
    distinct = scratch.cut(seen.groupBy("key", "digest").agg(F.count("*").alias("times"), F.min(F.struct("id", "mark", "first")).alias("at"), F.first("n").alias("n"), F.first("again").alias("again")), "distinct")
    groups = distinct.groupBy("key").agg(F.count("*").alias("different"), F.max("again").alias("any_again")).filter("different > 1 OR any_again")
    sorted_ones = distinct.join(groups, "key").filter("different > 1 OR again")
    sorted_ones = sorted_ones.select("at.id", "at.mark", F.struct("key", "digest", "at.first", "n", F.least(F.ceil(F.col("different") / MANY), F.lit(length - GRAM + 1)).cast("int").alias("deals")).alias("one"))
    wanted = scratch.cut(sorted_ones.groupBy("id", "mark").agg(F.collect_list("one").alias("wanted")), "wanted")
    may, _ = Sieve(wanted, "id", "mark").split(rows, F.col("id"), F.col("mark"))
    once = may.groupBy("id", "mark").agg(F.first("text").alias("text"))  # a segment is sorted once
    pieces = once.join(wanted, ["id", "mark"]).select("text", "wanted").mapInArrow(_cut_out(length), "key long, deal int, digest long, first int, n int, bytes binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pieces.repartition(parts, "key", "deal").sortWithinPartitions("key", "deal").mapInArrow(_sort(length), "key long, digest long, lo int, hi int")
    whole = distinct.filter("times > 1").select("key", "digest", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    twice = scratch.cut(found.unionByName(whole), "repeats")
    scratch.free(distinct, wanted)
    runs = seen.join(twice, ["key", "digest"]).select("id", "mark", F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + length).alias("hi")).alias("run"))
    runs = scratch.cut(runs.groupBy("id", "mark").agg(F.collect_set("run").alias("runs")), "runs")
    scratch.keep(runs)
    return runs


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    least_words: maximal runs of fewer words stay.
    """
    rows = _keyed(docs, id_col, text_col).select("id", "mark", "text")
    runs = _runs(rows, Scratch(docs.sparkSession), length)
    may, sure = Sieve(runs, "id", "mark").split(rows, F.col("id"), F.col("mark"))
    found = may.join(runs, ["id", "mark"], "left").select("id", "text", "runs").mapInArrow(_remove(least_words), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    rest = sure.select("id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return found.unionByName(rest).select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """docs with the repeated passages taken out of its text column, whole characters only."""
    rows = _keyed(docs, id_col, text_col)
    runs = _runs(rows.select("id", "mark", "text"), Scratch(docs.sparkSession), length)
    may, sure = Sieve(runs, "id", "mark").split(rows, F.col("id"), F.col("mark"))
    row = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in docs.schema)}>"
    met = may.select("row", "id", "mark").join(runs, ["id", "mark"], "left").select("row", "runs").mapInArrow(_strip(least_words, text_col), f"row {row}, text string")
    met = met.select(F.when(F.col("text").isNull(), F.col("row")).otherwise(F.col("row").withField(f"`{text_col}`", F.col("text"))).alias("row"))
    return met.unionByName(sure.select("row")).select("row.*")

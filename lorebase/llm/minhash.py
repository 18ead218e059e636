"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Method. A 32-bit universe of shingle hashes is permuted once (sigma); a second permutation (pi) is
shifted circularly by 1, 2, ... K, and the least value under each shift is one signature coordinate,
so two permutations make all K coordinates. Coordinates keep 16 bits; four neighbours form a band.

Flow, without a group in one task and without a row per pair of a group:
 1. one pass over the texts: set size, 64-bit digest of the set, signature. Equal sets form a class
    (map-side combined), and only its smallest document goes on;
 2. buckets of the bands; of buckets with the same members one is kept (near copies meet in many bands);
    a bucket over CHUNK members is dealt out as pairs of chunks;
 3. in each bucket the pairs whose signatures agree in `agree` coordinates are candidates; a bucket emits
    no pair of theirs, but a spanning forest of them. Their components are families: every candidate pair
    lies within one;
 4. the texts of a family of up to FAMILY shingles go to one task, which compares its members by signature and by further
    coordinates, and confirms promising pairs of different components on full sets;
 5. larger families do the same in steps: in each bucket every member names one earlier member that
    agrees; these links, at most one per member, are confirmed on full sets in tiles of TILE members a side, and give first
    components; buckets that still hold several components compare members of different components.
So no link between different texts is left out: each pair of a common bucket was confirmed, rejected, or lies
within one component. With 32 bands of 4 coordinates, a pair at a similarity of 0.75 shares no bucket 5 times in
a million; agree=0 confirms every pair of a bucket on full sets. Only texts that may belong to a family are moved.

Defined results: null or empty texts, and texts of white space, have an empty set, are linked with nothing
and are kept. Repeated rows (equal doc_id) are documents of their own of equal sets, whose smallest doc_id represents them all;
rows of one doc_id with different texts are told apart by their sets. A row without an id belongs to its text's
component. deduplicate keeps one row of each component, the one of the smallest doc_id (then of the smallest
text hash), a row without an id only where no row with one is in its component, and of rows of equal id and
text one. Extra columns are ignored, in deduplicate kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import U64, Scratch, Sieve, binary_chunks, connected_components, mix, passes, shingle_hashes, text_buffer, whole

U16, U32 = np.uint16, np.uint32
BANDS, ROWS = 32, 4
#: Coordinates in which a pair must agree to be confirmed; fewer agree at a similarity of 0.75 twice in a million pairs.
AGREE = 74
#: Further coordinates, of 8 bits, made for texts with a possible link only, and how many of them must agree
#: (fewer agree at a similarity of 0.75 once in a million pairs, at 0.6 as many in 3 of a thousand).
WIDE, WIDE_AGREE = 512, 338
#: Members of a bucket that are compared at once.
CHUNK = 1024
_NO_ID = -(1 << 63)
#: Shingles of a family, and its members, that one task confirms whole.
FAMILY, MEMBERS = 1 << 22, 4096
#: Documents of each side of a confirming tile.
TILE = 2048


def signatures(hashes: np.ndarray, bounds: np.ndarray, k: int = BANDS * ROWS, first: int = 1) -> np.ndarray:
    """Signature of each non-empty set: k coordinates of 16 bits, from shift `first` on (rows of empty sets are zero)."""
    out = np.zeros((len(bounds) - 1, k), U16)
    one, two = U32(0x9E3779B1), U32(0x85EBCA6B)
    shift = np.arange(first, first + k, dtype=U32) * one  # pi(x - k) begins with (x - k) * one
    full = np.flatnonzero(np.diff(bounds))
    i = 0
    while i < len(full):
        j = int(np.searchsorted(bounds[full + 1], bounds[full[i]] + 8192, "right"))
        j = max(j, i + 1)
        lo, hi = bounds[full[i]], bounds[full[j - 1] + 1]
        x = (mix(hashes[lo:hi] ^ U64(77)) >> U64(32)).astype(U32) * one
        starts = bounds[full[i:j]] - lo
        for c in range(0, k, 16):
            y = x[None, :] - shift[c : c + 16, None]
            y ^= y >> U32(15)
            y *= two
            y ^= y >> U32(13)
            out[full[i:j], c : c + 16] = (np.minimum.reduceat(y, starts, axis=1) >> U32(8)).astype(U16).T
        i = j
    return out


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(hashes ^ U64(3)))))
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) + np.diff(bounds).astype(U64)).view(np.int64)


def _describe(width: int):
    def run(batches):
        for batch in passes(batches, "text"):
            hashes, bounds = shingle_hashes(*text_buffer(batch.column("text")), width)
            sig = signatures(hashes, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(bounds)), pa.array(set_digests(hashes, bounds)), binary_chunks(sig.ravel(), np.arange(len(sig) + 1) * sig.shape[1], 2)],
                ["doc_id", "mark", "n_shingles", "digest", "sig"],
            )

    return run


def _bands(batches):
    """(key, node) rows from signatures; a key is a band's number and its four coordinates, mixed to 64 bits."""
    salt = mix(np.arange(BANDS, dtype=U64) + U64(1))
    for batch in batches:
        sig = np.frombuffer(text_buffer(batch.column(1))[0], U64)
        key = mix(mix(sig) ^ np.tile(salt, batch.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])


def _groups(batches, keys: int):
    """Tables of the rows of each group; rows come sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *changed.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def _ordered(t: pa.Table):
    """A bucket's nodes in ascending order with their set sizes, chunks, signatures and further coordinates."""
    order = np.argsort(t.column("node").to_numpy(), kind="stable")
    nodes, sizes, chunk = (t.column(c).to_numpy()[order] for c in ("node", "n_shingles", "chunk"))
    sig = np.frombuffer(text_buffer(t.column("sig"))[0], U16).reshape(len(nodes), -1)[order]
    wide = np.frombuffer(text_buffer(t.column("wide"))[0], np.uint8).reshape(len(nodes), -1)[order] if "wide" in t.column_names else None
    return nodes, sizes, chunk, sig, wide


def _near(nodes, sizes, chunk, sig, wide, percent: int, least: int):
    """For each member in ascending order: (its number, those of the agreeing earlier ones, in how many coordinates)."""
    mixed = (chunk != chunk[0]).any()
    for x in range(1, len(nodes)):
        agree = (sig[:x] == sig[x]).sum(axis=1)
        ok = agree >= least
        ok &= (np.minimum(sizes[:x], sizes[x]) * 100 >= np.maximum(sizes[:x], sizes[x]) * percent) & (nodes[:x] != nodes[x])
        if mixed:
            ok &= chunk[:x] != chunk[x]  # pairs within a chunk are another task's
        found = np.flatnonzero(ok)
        if wide is not None and len(found) and least:
            found = found[(wide[found] == wide[x]).sum(axis=1) >= WIDE_AGREE]
        if len(found):
            yield x, found, agree[found]


def _forest(percent: int, least: int):
    """A spanning forest of each bucket's candidate pairs, with in `best` for each member the pair that agrees most."""

    def run(batches):
        for _, t in _groups(batches, 3):
            nodes, *rest = _ordered(t)
            label, rows = np.arange(len(nodes)), []
            for x, found, agree in _near(nodes, *rest, percent, least):
                best = found[agree.argmax()]
                rows.append((nodes[best], nodes[x], True))
                label[label == label[x]] = label[best]
                for other in found[label[found] != label[x]].tolist():
                    if label[other] != label[x]:
                        rows.append((nodes[other], nodes[x], False))
                        label[label == label[other]] = label[x]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "b", "best"])

    return run


def _cross_links(percent: int, tiles: int, least: int):
    """Packed pairs whose components differ: (tile, a, b) with nodes as bytes."""

    def run(batches):
        for _, t in _groups(batches, 3):
            nodes, *rest = _ordered(t)
            component = dict(zip(t.column("node").to_pylist(), t.column("component").to_pylist(), strict=True))
            own = np.array([component[n] for n in nodes.tolist()], np.int64)
            a, b = [], []
            for x, found, _ in _near(nodes, *rest, percent, least):
                others = nodes[found[own[found] != own[x]]]
                a.append(others)
                b.append(np.full(len(others), nodes[x]))
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                ga, gb = (mix(v.view(U64)) % U64(tiles) for v in (a, b))
                tile = (np.minimum(ga, gb) * U64(tiles) + np.maximum(ga, gb)).astype(np.int64)
                parts = [(k, tile == k) for k in np.unique(tile)]
                yield pa.RecordBatch.from_arrays([pa.array([int(k) for k, _ in parts], pa.int64()), pa.array([a[m].tobytes() for _, m in parts], pa.binary()), pa.array([b[m].tobytes() for _, m in parts], pa.binary())], ["tile", "a", "b"])

    return run


def _pack(tiles: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ga, gb = (mix(v.astype(np.int64).view(U64)) % U64(tiles) for v in (a, b))
            tile = (np.minimum(ga, gb) * U64(tiles) + np.maximum(ga, gb)).astype(np.int64)
            each = np.arange(len(a) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(tile), binary_chunks(a, each, 8), binary_chunks(b, each, 8)], ["tile", "a", "b"])

    return run


def _needed(batches):
    for batch in batches:
        ids: dict[int, list] = {}
        for k, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ids.setdefault(k, []).append(np.unique(np.frombuffer(a + b, np.int64)))
        rows = [(k, np.unique(np.concatenate(v))) for k, v in ids.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([k for k, _ in rows], np.int64), [len(v) for _, v in rows])), pa.array(np.concatenate([v for _, v in rows]))], ["tile", "node"])


def _wide(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return signatures(hashes, bounds, WIDE, BANDS * ROWS + 1).astype(np.uint8)


def _sets(width: int):
    """(node, members, wide) of the rows whose text has its node's set."""

    def run(batches):
        for batch in passes(batches, "text"):
            hashes, bounds = shingle_hashes(*text_buffer(batch.column("text")), width)
            wide = _wide(hashes, bounds)
            out = pa.RecordBatch.from_arrays([batch.column("node"), binary_chunks(hashes, bounds, 8), binary_chunks(wide.ravel(), np.arange(len(wide) + 1) * WIDE, 1)], ["node", "members", "wide"])
            yield out.filter(pa.array(set_digests(hashes, bounds) == batch.column("node").to_numpy()))

    return run


def _families(width: int, percent: int, least: int):
    """Links within each family, as a spanning forest; rows (family, node, text) come sorted by family."""

    def run(batches):
        for _, t in _groups(batches, 1):
            texts = t.column("text").combine_chunks() if t.num_rows else t.column("text")
            hashes, bounds = shingle_hashes(*text_buffer(texts), width)
            node = t.column("node").to_numpy()
            right = np.flatnonzero(set_digests(hashes, bounds) == node)
            keep = right[np.unique(node[right], return_index=True)[1]]  # a set once, though its id may have other texts
            members = [hashes[bounds[i] : bounds[i + 1]] for i in keep]
            sizes = np.array([len(m) for m in members])
            flat, ends = np.concatenate(members) if members else hashes[:0], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            sig, wide, links = signatures(flat, ends), _wide(flat, ends), []
            label = np.arange(len(keep))
            for x, found, agree in _near(node[keep], sizes, np.zeros(len(keep), np.int32), sig, wide, percent, least):
                for y in found[np.argsort(-agree, kind="stable")].tolist():
                    if label[x] != label[y]:
                        both = _common(members[x], members[y])
                        if both * 100 >= percent * (sizes[x] + sizes[y] - both):
                            label[label == label[x]] = label[y]
                            links.append((node[keep[y]], node[keep[x]]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two ascending arrays share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _promising(least: int):
    """Pairs (a, b) whose further coordinates agree often enough."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(text_buffer(batch.column(c))[0], np.uint8).reshape(batch.num_rows, -1) for c in ("wide_a", "wide_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _confirm(percent: int):
    """Links of a tile that hold on full sets, as a spanning forest: rows (a, b)."""

    def run(batches):
        for _, t in _groups(batches, 1):
            members, pairs = {}, {}
            for node, a, b in zip(*(t.column(c).to_pylist() for c in ("node", "a", "b")), strict=True):
                if b is None:
                    members[node] = np.frombuffer(a, U64)
                else:
                    for x, y in zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist(), strict=True):
                        pairs.setdefault(x, set()).add(y)
            parent = {}

            def root(x, parent=parent):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links = []
            for x, ys in pairs.items():
                own = members[x]
                ys = sorted(ys)
                for i in range(0, len(ys), 256):
                    part = ys[i : i + 256]
                    sizes = np.array([len(members[y]) for y in part])
                    flat = np.concatenate([members[y] for y in part])
                    at = np.searchsorted(own, flat)
                    hit = own[np.minimum(at, len(own) - 1)] == flat
                    both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                    for y in np.array(part)[both * 100 >= percent * (len(own) + sizes - both)].tolist():
                        if root(x) != root(y):
                            parent[max(root(x), root(y))] = min(root(x), root(y))
                            links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def _classified(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, width: int, percent: int, agree: int) -> DataFrame:
    """(doc_id, mark, n_shingles, node, family): mark is the text's hash, node its set's digest (null: empty), family its component's least node."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = whole(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    unique = [F.coalesce("doc_id", F.lit(_NO_ID)), F.col("mark")]  # equal in rows of equal id and text alone
    described = scratch.cut(source.mapInArrow(_describe(width), "doc_id long, mark long, n_shingles long, digest long, sig binary"), "signatures")
    # A set's 64-bit digest names its class; `one` is a row that has it.
    classes = described.filter("n_shingles > 0").groupBy(F.col("digest").alias("node")).agg(F.min(F.struct(unique[0].alias("id"), "mark")).alias("one"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = scratch.cut(classes.select("node", "one.id", "one.mark", "n_shingles", "sig"), "classes")
    rows = classes.select("node", "sig").mapInArrow(_bands, "key long, node long")
    counts = rows.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("node").alias("x1"), F.bit_xor(F.xxhash64("node")).alias("x2")).filter("m > 1")
    counts = counts.groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m")
    members = (
        rows.join(counts, "key")
        .withColumn("n_chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int"))
        # chunk c meets every other chunk, and itself: a pair of chunks is one task's bucket
        .withColumn("other", F.explode(F.expr("sequence(0, n_chunks - 1)")))
        .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node")
    )
    members = scratch.cut(members, "buckets")
    bucket = ["key", "i", "j"]

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(classes.select("node", "n_shingles", "sig"), "node")
        return df.repartition(parts, *bucket).sortWithinPartitions(*bucket).select(*bucket, "chunk", "node", "n_shingles", "sig", *[c for c in ("component", "wide") if c in df.columns])

    forest = scratch.cut(dealt(members).mapInArrow(_forest(percent, agree), "a long, b long, best boolean").groupBy("a", "b").agg(F.max("best").alias("best")), "forest")
    families = connected_components(forest, scratch).select("node", F.col("component").alias("family"))
    nodes = families.join(classes.select("node", "id", "mark", "n_shingles"), "node")
    sizes = nodes.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    nodes = scratch.cut(nodes.join(sizes, "family").select("node", "id", "mark", "family", ((F.col("members") > MEMBERS) | (F.col("shingles") > FAMILY)).alias("large")), "nodes")
    # Only these texts can have a link; the others are not moved.
    may, _ = Sieve(nodes, "id", "mark").split(source, *unique)
    texts = may.groupBy(unique[0].alias("id"), "mark").agg(F.first("text").alias("text")).join(nodes, ["id", "mark"]).select("family", "node", "large", "text")
    small = texts.filter("NOT large").repartition(parts, "family").sortWithinPartitions("family").select("family", "node", "text")
    links = scratch.cut(small.mapInArrow(_families(width, percent, agree), "a long, b long"), "links")
    if nodes.filter("large").limit(1).count():
        links = links.unionByName(_large(scratch, texts.filter("large"), nodes, members, forest, dealt, parts, width, percent, agree))
    components = connected_components(links, scratch)
    out = described.withColumn("node", F.expr("CASE WHEN n_shingles > 0 THEN digest END")).select("doc_id", "mark", "n_shingles", "node")
    out = scratch.cut(out.join(components, "node", "left").select("doc_id", "mark", "n_shingles", "node", F.coalesce("component", "node").alias("family")), "classified")
    scratch.keep(out)
    return out


def _large(scratch: Scratch, texts: DataFrame, nodes: DataFrame, members: DataFrame, forest: DataFrame, dealt, parts: int, width: int, percent: int, agree: int) -> DataFrame:
    """Links of the families that no single task confirms."""
    own = nodes.filter("large").select("node")
    sets = scratch.cut(texts.select("node", "text").mapInArrow(_sets(width), "node long, members binary, wide binary").dropDuplicates(["node"]), "sets")
    tiles = max(1, math.ceil(own.count() / TILE))

    def confirm(packed: DataFrame) -> DataFrame:
        need = packed.mapInArrow(_needed, "tile long, node long").distinct()
        both = need.join(sets.select("node", "members"), "node").select("tile", "node", F.col("members").alias("a"), F.lit(None).cast("binary").alias("b"))
        both = both.unionByName(packed.select("tile", F.lit(0).cast("long").alias("node"), "a", "b"))
        return both.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_confirm(percent), "a long, b long")

    wide = sets.select("node", "wide")
    near = forest.filter("best").select("a", "b").join(wide.toDF("a", "wide_a"), "a").join(wide.toDF("b", "wide_b"), "b").mapInArrow(_promising(WIDE_AGREE if agree else 0), "a long, b long")
    packed = scratch.cut(near.mapInArrow(_pack(tiles), "tile long, a binary, b binary"), "near")
    links = scratch.cut(confirm(packed), "first")
    # Every member has a component, if only its own.
    labels = own.join(connected_components(links, scratch), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labelled = members.join(scratch.cut(labels, "labels"), "node")
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    rest = dealt(labelled.join(several, "key", "left_semi").join(wide, "node"))
    cross = scratch.cut(rest.mapInArrow(_cross_links(percent, tiles, agree), "tile long, a binary, b binary"), "cross")
    return links.unionByName(scratch.cut(confirm(cross), "second"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, agree: int = AGREE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest reachable id), kept.

    agree: coordinates of 128 in which a pair must agree to be confirmed on full sets; with 0 all pairs of a bucket are.
    """
    found = _classified(docs, Scratch(docs.sparkSession), id_col, text_col, width, percent, agree)
    least = found.filter("family IS NOT NULL").groupBy("family").agg(F.min("doc_id").alias("least"))
    out = found.join(least, "family", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, agree: int = AGREE) -> DataFrame:
    """The rows of docs that stay: one of each component. Rows that surely stay are not moved."""
    scratch = Scratch(docs.sparkSession)
    found = _classified(docs, scratch, id_col, text_col, width, percent, agree).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    first = found.filter("family IS NOT NULL").groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull(), "id", "mark")).alias("first"))
    rows = found.groupBy("id", "mark").agg(F.count("*").alias("times"), F.first("family").alias("family"))
    rows = rows.join(first.select("family", "first.id", "first.mark", F.lit(True).alias("stays")), ["family", "id", "mark"], "left").select("id", "mark", (F.col("stays").isNotNull() | F.col("family").isNull()).alias("stays"), "times")
    rows = scratch.cut(rows.filter("NOT stays OR times > 1"), "contested")
    scratch.keep(rows)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    may, sure = Sieve(rows, "id", "mark").split(keyed, F.col("id"), F.col("mark"))
    once = may.groupBy("id", "mark").agg(F.first("row").alias("row")).join(rows.select("id", "mark", "stays"), ["id", "mark"], "left")
    return sure.select("row").unionByName(once.filter(F.coalesce("stays", F.lit(True))).select("row")).select("row.*")

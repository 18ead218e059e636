"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one and turned by three rounds of fixed random signs and a fast Hadamard transform; the
hash is the signed axis nearest to the turned vector. The bucket of a table is the combination of two such hashes, or of
more where the rows are so many that buckets would grow. A query also probes the combinations whose axes
are next best, by the sum of squared gaps to its best ones. All hashes but the last name a cell, where rows and queries meet;
in it a query looks only at the rows of the last hashes that it probes. Cells are dealt over blocks of bounded size by a hash
of the candidate's id, so that a vector with very many copies does not fill one task, and only each query's best
rows leave a block; distances are always the exact Euclidean distances of the original vectors in double
precision. The best of a task, and then of all tasks, are merged. Every row is indexed; nothing is sampled.

Defined results: vectors that are null, empty, zero, of another length than the most common one, or that
hold null or non-finite numbers take no part. Ties go to the smaller id; repeated ids count once.
With fewer candidates than k, all that are found are returned. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import Scratch, binary_chunks, constants, text_buffer

#: Probes of a table are this number to the power of its hashes, and more where they would meet fewer than MEET rows.
TABLES, PROBES, MEET = 8, 20, 500
#: Candidates and queries that meet at once.
BLOCK, QUERIES = 4096, 512
#: Vectors that are turned at once.
BATCH = 1024
#: Found rows that a task holds.
HELD = 1 << 20


def turned(unit: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of signs and a Hadamard transform, on vectors padded to a power of two."""
    n = 1 << max(0, math.ceil(math.log2(max(1, unit.shape[1]))))
    x = np.zeros((len(unit), n))
    x[:, : unit.shape[1]] = unit
    for r in range(3):
        x = x * np.where(constants(n, 1000 + 10 * table + r) >> np.uint64(63), -1.0, 1.0)
        h = 1
        while h < n:
            x = x.reshape(-1, n // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(-1, n)
            h *= 2
        x /= math.sqrt(n)
    return x


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(text_buffer(column)[0], np.float64).reshape(-1, dim)


def hashes(n: int, axes: int) -> int:
    """Hashes of a bucket for n rows: two, or as many as leave a bucket two rows on average."""
    return max(2, int(math.log(max(2, n / 2)) / math.log(axes)))


def _probed(gaps: list[np.ndarray], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, last hash) of the combinations of axes with the least summed gaps; gaps: one array of axes per hash."""
    axes = len(gaps[0])
    keys, cost = np.zeros(1, np.int64), np.zeros(1)
    for gap in gaps:
        near = np.argsort(gap, kind="stable")[:probes]
        both = (cost[:, None] + gap[near][None, :]).ravel()
        best = np.argsort(both, kind="stable")[:probes]
        keys, cost = keys[best // len(near)] * axes + near[best % len(near)], both[best]
    return keys // axes, keys % axes


def _buckets(dim: int, tables: int, n_hashes: int, probes: int):
    """(table, cell, last, id, vector) rows; last: the last hash, or with several probes those of the cell, as bytes of int32."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                ids, v = part.column(0).to_numpy(), _vectors(part.column(1), dim)
                unit = v / np.abs(v).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                for t in range(tables):
                    both = [np.concatenate((x, -x), axis=1) for x in (turned(unit, t * n_hashes + h) for h in range(n_hashes))]
                    axes = both[0].shape[1]
                    if probes == 1:
                        key = np.zeros(len(ids), np.int64)
                        for x in both:
                            key = key * axes + x.argmax(axis=1)
                        at, cell, last = np.arange(len(ids)), key // axes, [x.tobytes() for x in (key % axes).astype(np.int32)]
                    else:
                        at, cell, last = [], [], []
                        gaps = [(x.max(axis=1, keepdims=True) - x) ** 2 for x in both]
                        for i in range(len(ids)):
                            cells, lasts = _probed([g[i] for g in gaps], probes)
                            order = np.argsort(cells, kind="stable")
                            cells, lasts = cells[order], lasts[order].astype(np.int32)
                            edges = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                            at += [i] * len(edges)
                            cell += cells[edges].tolist()
                            last += [x.tobytes() for x in np.split(lasts, edges[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(cell, pa.int64()), pa.array(last, pa.binary()), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], ["table", "cell", "last", "id", "vector"])

    return run


def _best(dim: int, k: int):
    """Each query's k best of every block; rows come sorted by block, candidates (side 0) first."""

    def meet(cand: list, quer: list):
        ids, last, vectors = (np.concatenate([c[j] for c in cand]) for j in range(3))
        order = np.argsort(last, kind="stable")
        ids, last, vectors = ids[order], last[order], vectors[order]
        rows: list = []
        for own, lasts, q in quer:
            for i in range(len(own)):
                lo, hi = np.searchsorted(last, lasts[i]), np.searchsorted(last, lasts[i], "right")
                at = np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
                at = at[ids[at] != own[i]]
                d = vectors[at] - q[i]
                d = np.sqrt((d * d).sum(axis=1))
                if len(d) > k:
                    best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    at, d = at[best], d[best]
                best = np.lexsort((ids[at], d))[:k]
                rows.append((np.full(len(best), own[i]), ids[at][best], d[best]))
        return rows

    def settled(rows: list) -> list:
        """The k best of each query among rows."""
        q, c, d = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((c, d, q))
        q, c, d = q[order], c[order], d[order]
        new = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))
        q, c, d = q[new], c[new], d[new]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        return [(q[place < k], c[place < k], d[place < k])]

    def emitted(rows: list):
        for q, c, d in settled(rows) if rows else []:
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(d)], ["query_id", "vec_id", "score"])

    def run(batches):
        """Settles whenever HELD rows have come together, and lets go of what then remains if that is over half as many."""
        rows: list = []
        for more in _met(batches):
            rows += more
            if sum(len(r[0]) for r in rows) > HELD:
                rows = settled(rows)
                if len(rows[0][0]) > HELD // 2:
                    yield from emitted(rows)
                    rows = []
        yield from emitted(rows)

    def _met(batches):
        block, cand, quer = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            ids, v = batch.column(4).to_numpy(), _vectors(batch.column(6), dim)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[lo, :3]) != block:
                    if cand and quer:
                        yield meet(cand, quer)
                    block, cand, quer = tuple(keys[lo, :3]), [], []
                if keys[lo, 3] == 0:
                    cand.append((ids[lo:hi], np.frombuffer(text_buffer(batch.column(5).slice(lo, hi - lo))[0], np.int32), v[lo:hi]))
                else:
                    quer.append((ids[lo:hi], [np.frombuffer(x, np.int32) for x in batch.column(5).slice(lo, hi - lo).to_pylist()], v[lo:hi]))
                    if cand and sum(len(x[0]) for x in quer) >= QUERIES:
                        yield meet(cand, quer)
                        quer = []
        if cand and quer:
            yield meet(cand, quer)

    return run


def _to_bytes(dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy().astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_chunks(flat, np.arange(batch.num_rows + 1) * dim, 8)], ["id", "vector"])

    return run


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """For each row of vectors that is_query holds for: query_id, rank, vec_id, score of its k nearest found."""
    spark = vectors.sparkSession
    number = F.col(vector_col).cast("array<double>")
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), number.alias("v"), is_query.alias("is_query"))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).dropDuplicates(["id"])
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0].dim
    rows = rows.filter(F.size("v") == dim)
    bytes_of = _to_bytes(dim)
    scratch = Scratch(spark)
    packed = scratch.cut(rows.select("id", "v").mapInArrow(bytes_of, "id long, vector binary"), "vectors")
    asked = rows.filter("is_query").select("id", "v").mapInArrow(bytes_of, "id long, vector binary")
    n, axes = packed.count(), 2 << max(0, math.ceil(math.log2(dim)))
    n_hashes = hashes(n, axes)
    n_probes = min(axes**n_hashes, max(probes**n_hashes, math.ceil(MEET * axes**n_hashes / n)))
    schema = "table int, cell long, last binary, id long, vector binary"
    candidates = scratch.cut(packed.mapInArrow(_buckets(dim, tables, n_hashes, 1), schema), "index")
    scratch.free(packed)
    blocks = candidates.groupBy("table", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    candidates = candidates.join(blocks, ["table", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    met = asked.mapInArrow(_buckets(dim, tables, n_hashes, n_probes), schema)
    met = met.join(blocks, ["table", "cell"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.lit(1))
    columns = ["table", "cell", "block", "side", "id", "last", "vector"]
    met = candidates.select(columns).unionByName(met.select(columns))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64)
    found = met.repartition(parts, "table", "cell", "block").sortWithinPartitions("table", "cell", "block", "side").mapInArrow(_best(dim, k), "query_id long, vec_id long, score double")
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact vector searches by cells around pivots: top k of queries, and all pairs over a similarity.

Vectors, scaled to length one, belong to the cell of their nearest pivot. Distances between them say what cosines do: a
cosine of t is a distance of sqrt(2 - 2t). Two bounds tell that a cell holds nothing near a vector x: the cell's radius (its
rows are at least d(x, pivot) - radius away) and the plane between two pivots (a row of cell j is at least
(d(x, pj)^2 - d(x, pi)^2) / (2 d(pi, pj)) from x). Both are used with a slack above the rounding of doubles, so no
result is lost; pivots only decide how much is compared.

Pivots are fitted to a bounded sample (SAMPLE rows a pivot, MOST_PIVOTS pivots), which also tells how many pay; they are the only thing that every task
holds besides a few numbers per cell. Cells with more rows than fit a task are dealt over blocks by a hash of the id.
Vectors of length zero have the cosine 0 to all others; they are a cell of their own in searches, and in no pair of a positive cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lorebase.sources.shared import cut

#: Rows of a cell that are tried, pivots at most, rows of the sample for each, and comparisons that cost as much as to move a row.
CELL_ROWS, MOST_PIVOTS, SAMPLE, MOVE = (4096, 1024, 256, 64), 1024, 8, 100
#: Rows of a block of a cell, for pairs and for searches, at 64 numbers a row; fewer if they are longer.
PAIR_BLOCK, CORPUS_PART = 4096, 16384
#: Rows compared at once, and rows of the nearest cells a query sees first, for each that it asks for.
STEP, FIRST = 256, 8
#: Similarities of a search held at once, and rows that leave a router in one batch.
COMPARED, ROUTED = 1 << 19, 8192
SLACK = 1e-7


def unit(column: pa.Array) -> np.ndarray:
    vec = matrix(column)
    size = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
    return np.where(size > 0, vec / np.where(size > 0, size, 1), 0.0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def fit(sample: np.ndarray, many: int, rounds: int = 6) -> np.ndarray:
    """Centres of a sample of unit vectors: spread-out rows of it, moved to the means of their cells."""
    at, far = [0], distances(sample, sample[:1])[:, 0]
    while len(at) < min(many, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[at[-1:]])[:, 0])
    centres = sample[at]
    for _ in range(rounds):
        home = distances(sample, centres).argmin(axis=1)
        used = np.unique(home)
        centres = np.array([sample[home == c].mean(axis=0) for c in used])
    return centres


@dataclass
class Cells:
    """Pivots with what is known of their cells; the last cell is that of the zero vectors."""

    centres: np.ndarray
    count: np.ndarray
    nearest: np.ndarray
    radius: np.ndarray

    def __post_init__(self):
        self.between = distances(self.centres, self.centres)

    def blocks(self, size: int) -> np.ndarray:
        return np.maximum(1, np.ceil(self.count / max(1, size * 64 // max(64, self.centres.shape[1])))).astype(np.int64)

    def plane(self, home: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Distance of each vector from the plane towards every other cell."""
        own = away[np.arange(len(away)), home][:, None]
        gap = self.between[home]
        return np.where(gap > 0, (away * away - own * own) / np.where(gap > 0, 2 * gap, 1), 0)

    def least(self, home: np.ndarray, away: np.ndarray) -> np.ndarray:
        """A distance that no row of the cell is nearer than; infinite for empty cells."""
        filled = len(self.centres)
        low = np.maximum(np.maximum(away - self.radius[:filled], self.nearest[:filled] - away), np.maximum(self.plane(home, away), 0))
        return np.where(self.count[:filled] > 0, np.maximum(low - SLACK, 0), np.inf)


def placed(rows: DataFrame, cost: Callable[[Cells, np.ndarray, int], float], cell_rows: int | None = None) -> tuple[DataFrame, Cells]:
    """(rows with cell and away, the distance from its pivot, written; the cells). rows: id, embedding and more.

    cost(cells, the sample's distances from their pivots, rows of the table): what a search would compare and move for a row.
    The number of pivots with the least is taken; vectors without groups get one, that is, a search by blocks alone.
    """
    n = rows.count()
    tried = sorted({max(1, min(MOST_PIVOTS, n // size)) for size in ([cell_rows] if cell_rows else CELL_ROWS)} | (set() if cell_rows else {1}))
    sample = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE * tried[-1]).toPandas()
    vectors = np.array(sample["embedding"].tolist(), np.float64).reshape(len(sample), -1 if len(sample) else 1)
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    vectors = (vectors / np.where(size > 0, size, 1))[size[:, 0] > 0]
    dim = max(1, vectors.shape[1])
    centres, least = np.zeros((1, dim)), np.inf
    for many in tried if len(vectors) else ():
        own = fit(vectors, many)
        away = distances(vectors, own)
        home = away.argmin(axis=1)
        near = [away[home == c, c] for c in range(len(own))]
        guess = Cells(own, np.array([*(len(x) for x in near), 0]) * n / len(vectors), np.array([*(x.min(initial=np.inf) for x in near), 0]), np.array([*(x.max(initial=0) for x in near), 0]))
        if len(tried) == 1 or cost(guess, away, n) < least:
            centres, least = own, cost(guess, away, n)
    at = rows.columns.index("embedding")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                vec = unit(piece.column(at))
                away = distances(vec, centres)
                zero = ~vec.any(axis=1)
                home = np.where(zero, len(centres), away.argmin(axis=1))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(home.astype(np.int32)), pa.array(np.where(zero, 0, away.min(axis=1)))], [*piece.schema.names, "cell", "away"])

    out = cut(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())])), "cells")
    known = {r.cell: r for r in out.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()}
    numbers = [(known[c].n, known[c].lo, known[c].hi) if c in known else (0, 0.0, 0.0) for c in range(len(centres) + 1)]
    count, lo, hi = (np.array(x) for x in zip(*numbers, strict=True))
    return out, Cells(centres, count.astype(np.int64), lo, hi)


def spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _keys(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(n)]) if batch.num_rows else np.zeros((0, n), np.int64)


def _mixed(ids: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A block of 0 to many - 1 for each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % many


def told(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of cells i and j are compared in j: one of the two, dealt evenly."""
    return ((i + j) % 2 == 0) == (i < j)


def pair_groups(vectors: DataFrame, threshold: float, cell_rows: int | None = None, block: int | None = None) -> DataFrame:
    """Rows by the groups in which they are compared: cell, i, j (blocks of the cell), role, away, id, embedding.

    role 0: held rows, in a group of one block compared with one another; 1: rows of block j; 2: copies of rows of other cells.
    """
    rows = vectors.filter("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def cost(cells: Cells, away: np.ndarray, n: int) -> float:
        near = cells.least(away.argmin(axis=1), away) <= reach
        met = (near * cells.count[None, :-1]).sum(axis=1).mean() / 2
        return met + MOVE * (near * cells.blocks(block or PAIR_BLOCK)[None, :-1]).sum(axis=1).mean() / 2

    rows, cells = placed(rows, cost, cell_rows)
    if threshold > 0:
        rows = rows.filter(F.col("cell") < len(cells.centres))
    blocks = cells.blocks(block or PAIR_BLOCK)
    filled = len(cells.centres)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                ids, home, vec = piece.column(0).to_numpy(), piece.column(2).to_numpy().astype(np.int64), unit(piece.column(1))
                away, own = distances(vec, cells.centres), _mixed(ids, blocks[home])
                # At home a row meets each block of its cell once.
                many = blocks[home]
                at = np.repeat(np.arange(len(ids)), many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                mine = own[at]
                parts = [(at, home[at], np.minimum(mine, other), np.maximum(mine, other), (mine > other).astype(np.int64), piece.column(3).to_numpy()[at])]
                real = home < filled  # zero vectors are compared in their own cell's groups and everywhere
                near = np.ones((len(ids), filled), bool)
                near[real] = (cells.least(home[real], away[real]) <= reach) & told(home[real][:, None], np.arange(filled)[None, :])
                near &= (cells.count[:filled] > 0) & (np.arange(filled)[None, :] != home[:, None])
                at, cell = np.nonzero(near)
                many = blocks[cell]
                again = np.repeat(np.arange(len(at)), many)
                to = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                parts.append((at[again], cell[again], to, to, np.full(len(to), 2), away[at[again], cell[again]]))
                for at, cell, i, j, role, far in parts:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (cell, i, j, role)), pa.array(far), piece.column(0).take(pa.array(at)), piece.column(1).take(pa.array(at))], ["cell", "i", "j", "role", "away", "id", "embedding"])

    return rows.mapInArrow(run, f"cell int, i int, j int, role int, away double, id long, embedding {dict(rows.dtypes)['embedding']}")


def compared(groups: DataFrame) -> DataFrame:
    """One row: pairs that the groups compare at most, before distances from the pivot are looked at; and rows moved."""
    sizes = groups.groupBy("cell", "i", "j").agg(*[F.sum((F.col("role") == r).cast("long")).alias(f"n{r}") for r in range(3)])
    own = F.when(F.col("i") == F.col("j"), F.expr("n0 * (n0 - 1) div 2")).otherwise(0)
    return sizes.agg(F.coalesce(F.sum(own + F.col("n0") * (F.col("n1") + F.col("n2"))), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.expr("n0 + n1 + n2")), F.lit(0)).alias("rows"))


def similar_pairs(vectors: DataFrame, threshold: float, cell_rows: int | None = None, block: int | None = None) -> DataFrame:
    """a, b, similarity of all pairs a < b whose cosine reaches the threshold. vectors: id, embedding.

    A row is at home in one cell and copied to those cells in whose reach it is; of two cells only one compares their rows,
    so each pair is told once. A group holds a block of a cell; all else passes in Arrow batches, sorted by its distance
    from the pivot, and meets only those held rows whose distance differs by what the threshold allows.
    """
    groups = pair_groups(vectors, threshold, cell_rows, block)
    tasks, reach = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    groups = groups.repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "role", "away")

    def found(held, ids, vec, away, itself: bool):
        """Pairs of held rows and others; itself: the others are held, too, so the greater id is left out."""
        for lo in range(0, len(ids), STEP):
            part = slice(lo, lo + STEP)
            begin, end = np.searchsorted(held[2], [away[part][0] - reach, away[part][-1] + reach])
            sim = held[1][begin:end] @ vec[part].T
            x, y = np.nonzero(sim >= threshold)
            a, b = held[0][begin:end][x], ids[part][y]
            keep = a < b if itself else a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(sim[x, y][keep])], ["a", "b", "similarity"])

    def run(batches):
        key, pieces, held = None, [], None

        def settled():
            nonlocal held, pieces
            if pieces:
                held, pieces = tuple(np.concatenate(x) for x in zip(*pieces, strict=True)), []
                if key[1] == key[2]:
                    yield from found(held, *held, True)

        for batch in batches:
            keys = _keys(batch, 4)
            for lo, hi in spans(keys):
                piece = batch.slice(lo, hi - lo)
                if tuple(keys[lo, :3]) != key:
                    yield from settled()
                    key, held = tuple(keys[lo, :3]), None
                rows = piece.column(5).to_numpy(), unit(piece.column(6)), piece.column(4).to_numpy()
                if keys[lo, 3] == 0:
                    pieces.append(rows)
                else:
                    yield from settled()
                    if held is not None:
                        yield from found(held, *rows, False)
        yield from settled()

    return groups.mapInArrow(run, "a long, b long, similarity double")


def nearest(held: tuple, asked: tuple, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of a query repeated, ids of its k nearest held rows, cosines) for each query.

    held: ids, vectors, their lengths, columns; asked: ids, vectors, least cosines, columns that must agree. No more than COMPARED numbers, or those
    of one query, are in memory at once, twice.
    """
    ids, vec, size, theirs = held
    step = max(1, COMPARED // max(1, len(ids)))
    for lo in range(0, len(asked[0]), step):
        q_ids, q_vec, least = (x[lo : lo + step] for x in asked[:3])
        sim = q_vec @ vec.T
        scale = np.sqrt((q_vec * q_vec).sum(axis=1))[:, None] * size[None, :]
        real = scale > 0
        np.divide(sim, scale, out=sim, where=real)
        sim[~real] = 0.0
        del scale
        allowed = (q_ids[:, None] != ids[None, :]) & (sim >= least[:, None] - SLACK)
        for mine, other in zip(asked[3], theirs, strict=True):
            allowed &= mine[lo : lo + step, None] == other[None, :]
        for i in range(len(q_ids)):
            own = np.flatnonzero(allowed[i])
            far = -np.round(sim[i][own], 12)
            if len(own) > k:  # all that tie with the k-th stay until ids decide
                near = far <= np.partition(far, k - 1)[k - 1]
                own, far = own[near], far[near]
            own = own[np.lexsort((ids[own], far))][:k]
            yield np.full(len(own), q_ids[i]), ids[own], sim[i][own]


def knn(queries: DataFrame, corpus: DataFrame, k: int, same: list[str] | None = None, cell_rows: int | None = None) -> DataFrame:
    """Exact nearest neighbours by cosine: query_id, id, similarity, rank; a row is not its own neighbour.

    queries: query_id, embedding; corpus: id, embedding; same: columns that must agree on both sides. A query first sees the cells
    around it, until they have FIRST rows for each that it asks for. Its k-th similarity there is a bound: in the second
    round it goes only to cells that can hold a row as near, and only such rows leave them. The corpus is placed once and moves once a round.
    """
    same = same or []
    rows = corpus.filter("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding", *same)

    def cost(cells: Cells, away: np.ndarray, n: int) -> float:
        """With the distance at which a row's own cell has k rows for what is near."""
        full = np.sort(away[np.arange(len(away)), away.argmin(axis=1)])
        near = cells.least(away.argmin(axis=1), away) <= 1.5 * full[len(full) // 2]
        return ((near * cells.count[None, :-1]).sum(axis=1) + MOVE * near.sum(axis=1)).mean()

    rows, cells = placed(rows, cost, cell_rows)
    asked = queries.filter("query_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast(rows.schema["embedding"].dataType).alias("embedding"), *same)
    parts, filled = cells.blocks(CORPUS_PART), len(cells.centres)
    tasks = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(parts.sum()) // 16)
    left = rows.select("cell", F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts.tolist()), F.col("cell") + 1)).cast("int").alias("part"), F.lit(0).alias("side"), "id", "embedding", F.lit(None).cast("double").alias("least"), *same)

    def routes(first: bool) -> Callable:
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, STEP):
                    piece = batch.slice(lo, STEP)
                    vec = unit(piece.column(1))
                    away = distances(vec, cells.centres)
                    order = np.argsort(away, axis=1, kind="stable")
                    seen = np.cumsum(cells.count[order], axis=1) - cells.count[order] < FIRST * k
                    goes = np.zeros((len(vec), filled + 1), bool)
                    np.put_along_axis(goes, order, seen, axis=1)
                    if not first:
                        least = np.array([-np.inf if x is None else x for x in piece.column(2).to_pylist()])
                        zero = ~vec.any(axis=1)
                        low = np.minimum(cells.least(away.argmin(axis=1), away), 3)  # an empty cell's bound is no number
                        best = np.where(zero[:, None], 0, 1 - low * low / 2)
                        best = np.concatenate((best, np.zeros((len(vec), 1))), axis=1)  # the zero vectors
                        goes = ~goes & (best + SLACK >= least[:, None])
                    goes &= cells.count > 0
                    at, cell = np.nonzero(goes)
                    many = parts[cell]
                    again = np.repeat(np.arange(len(at)), many)
                    part = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                    at, cell = at[again], cell[again]
                    for low in range(0, len(part), ROUTED):
                        some = slice(low, low + ROUTED)
                        took = piece.take(pa.array(at[some]))
                        yield pa.RecordBatch.from_arrays([pa.array(cell[some].astype(np.int32)), pa.array(part[some].astype(np.int32)), pa.array(np.ones(took.num_rows, np.int32)), *took.columns], ["cell", "part", "side", *piece.schema.names])

        return run

    def best(batches):
        key, pieces, held, done = None, [], None, []
        for batch in batches:
            keys = _keys(batch, 3)
            for lo, hi in spans(keys):
                piece = batch.slice(lo, hi - lo)
                if tuple(keys[lo, :2]) != key:
                    key, pieces, held = tuple(keys[lo, :2]), [], None
                others = [np.array(piece.column(6 + j).to_pylist(), object) for j in range(len(same))]
                rows = piece.column(3).to_numpy(), matrix(piece.column(4)), np.array([-np.inf if x is None else x for x in piece.column(5).to_pylist()]), others
                if keys[lo, 2] == 0:
                    pieces.append(rows)
                    continue
                if held is None and pieces:
                    vec = np.vstack([p[1] for p in pieces])
                    held = np.concatenate([p[0] for p in pieces]), vec, np.sqrt((vec * vec).sum(axis=1)), [np.concatenate([p[3][j] for p in pieces]) for j in range(len(same))]
                    pieces = []
                if held:
                    done += nearest(held, rows, k)
            if done:
                q, i, s = (np.concatenate(x) for x in zip(*done, strict=True))
                done.clear()
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s)], ["query_id", "id", "similarity"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in same)
    vector = asked.schema["embedding"].dataType.simpleString()
    routed = "cell int, part int, side int, query_id long, embedding " + vector + ", least double" + (", " + types if types else "")

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        right = queries.select("query_id", "embedding", "least", *same).mapInArrow(routes(first), routed).withColumnRenamed("query_id", "id")
        met = left.unionByName(right.select(left.columns)).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "side")
        return met.mapInArrow(best, "query_id long, id long, similarity double")

    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id"))
    near = cut(meet(asked.withColumn("least", F.lit(None).cast("double")), True), "near")
    kth = near.withColumn("rank", order).filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
    far = meet(asked.join(kth, "query_id", "left"), False)
    return near.unionByName(far).withColumn("rank", order).filter(F.col("rank") <= k)

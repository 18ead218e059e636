"""Hard negatives by rotated one-bit codes.

Each vector is taken relative to its block's rounded mean (see blocks), turned by fixed signs and Hadamard transforms, and kept as
one sign bit per component. Stored beside it are its alignment, the inner product with its code as a unit vector, and its
residual, the length of what the code does not tell. A query is turned too and rounded to PLANES bits a component, so that
its product with a code is a sum of popcounts; what rounding took away is bounded by its length. From these follows an
interval that holds the true product for certain: mean's part + alignment * estimate, give or take the residual times the
query's part that is orthogonal to the code (Cauchy-Schwarz). Rows whose interval cannot matter are dropped; all others
are scored by exact integer products.

Anchors go to their own part first. What they find there is the bound at all other parts, for positives and for negatives.

Defined results: vectors that are null, empty, of another length than the most common one, or that hold null or non-finite
numbers, and rows with a null label or id take no part. Of rows with equal ids the one with the greatest label and then vector takes
part. Ties go to the smaller id. An anchor without other rows of its label, or a positive with a negative score, has no
negatives. Scores beyond 64 bits are an error. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm import blocks
from lorebase.llm.common import Scratch, binary_chunks
from lorebase.llm.neighbours import turned

PLANES = 6
ROTATION = 77
LEAST, MOST = blocks.LONGS


def _centre(matrix: np.ndarray) -> np.ndarray:
    return np.rint(matrix.mean(axis=0))


def encode(delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, 64 to a word; alignment with the code; residual) of vectors."""
    x = turned(delta, ROTATION)
    n = x.shape[1]
    bits = np.packbits(x >= 0, axis=1, bitorder="little")
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
    align = np.abs(x).sum(axis=1) / np.sqrt(n)
    return bits, align, np.sqrt(np.maximum((delta * delta).sum(axis=1) - align * align, 0))


def describe(dim: int):
    """Columns of a block's rows: code, alignment, residual."""

    def run(matrix: np.ndarray) -> list:
        bits, align, rest = encode(matrix - _centre(matrix))
        return [binary_chunks(bits.ravel(), np.arange(len(bits) + 1) * bits.shape[1], 8), pa.array(align), pa.array(rest)]

    return run


def intervals(q: np.ndarray, bits: np.ndarray, align: np.ndarray, rest: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of the product of each query with each coded row; centre: products with the row's block's centre."""
    y = turned(q, ROTATION)
    n = y.shape[1]
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
    units = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
    lost = np.sqrt(((y - low[:, None] - step[:, None] * units) ** 2).sum(axis=1))
    weighed = np.zeros((len(q), len(bits)), np.int64)
    for plane in range(PLANES):
        mask = np.packbits(units >> plane & 1, axis=1, bitorder="little")
        mask = np.pad(mask, ((0, 0), (0, -mask.shape[1] % 8))).view(np.uint64)
        for word in range(bits.shape[1]):
            weighed += np.bitwise_count(bits[None, :, word] & mask[:, word, None]).astype(np.int64) << plane
    ones = np.bitwise_count(bits).sum(axis=1)[None, :]
    dots = 2 * (low[:, None] * ones + step[:, None] * weighed) - (low * n + step * units.sum(axis=1))[:, None]
    at = dots / np.sqrt(n)
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    near = np.maximum(np.abs(at) - lost[:, None], 0)
    wide = align[None, :] * lost[:, None] + rest[None, :] * np.sqrt(np.maximum(size * size - near * near, 0))
    wide += 1e-9 * (size * (align + rest)[None, :] + np.abs(centre)) + 1e-6  # rounding of the doubles above
    middle = centre + align[None, :] * at
    return middle - wide, middle + wide


class Part:
    """A part's rows, sorted by label and block, with their codes."""

    def __init__(self, ids, labels, block, matrix, bits, align, rest):
        self.ids, self.labels, self.matrix, self.bits, self.align, self.rest = ids, labels, matrix, bits, align, rest
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.number = np.cumsum(np.append(False, block[1:] != block[:-1]))
        self.centres = np.array([_centre(m) for m in np.split(matrix, first[1:])])
        self.seen = self.scored = 0

    def rows(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def between(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        if not blocks.in_doubles(q, self.matrix):  # no interval in doubles: everything survives
            shape = len(q), len(self.ids[rows])
            return np.full(shape, -np.inf), np.full(shape, np.inf)
        centre = (q @ self.centres.T)[:, self.number[rows]]
        return intervals(q, self.bits[rows], self.align[rows], self.rest[rows], centre)

    def scores(self, q: np.ndarray, rows: slice, survive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the rows that survive for any query, their scores; -inf where they do not survive for the query)."""
        at = np.flatnonzero(survive.any(axis=0)) + rows.start
        self.seen += survive.size
        self.scored += int(survive.sum())
        got = blocks.products(q, self.matrix[at])
        got = np.where(survive[:, at - rows.start], got, -np.inf)
        return at, got


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then id."""
    if len(score) > k and score.dtype != object:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)


def _hold(dim: int):
    def hold(table: pa.Table) -> Part:
        columns = [table[c].to_numpy() for c in ("id", "label", "block")]
        code = np.vstack([np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in table["more0"].chunks])
        return Part(*columns, np.vstack([blocks.matrix_of(c, dim) for c in table["vector"].chunks]), code, table["more1"].to_numpy(), table["more2"].to_numpy())

    return hold


def _positives(dim: int, k: int):
    def answer(part: Part, batch: pa.RecordBatch):
        own, label, q = batch["id"].to_numpy(), batch["label"].to_numpy(), blocks.matrix_of(batch["vector"], dim)
        floor = np.array([-np.inf if s is None else float(s) for s in batch["floor_score"].to_pylist()])
        floor_id = np.array([MOST if i is None else i for i in batch["floor_id"].to_pylist()], np.int64)
        out: list = []
        for kind in np.unique(label):
            rows, asks = part.rows(kind), np.flatnonzero(label == kind)
            if rows.start == rows.stop:
                continue
            other = part.ids[rows][None, :] != own[asks][:, None]
            lower, upper = part.between(q[asks], rows)
            sure = np.where(other, lower, -np.inf)
            least = floor[asks]
            if sure.shape[1] >= k:
                least = np.maximum(least, np.partition(sure, -k, axis=1)[:, -k])
            at, got = part.scores(q[asks], rows, other & (upper >= least[:, None]))
            for i, a in enumerate(asks):
                score = got[i]
                fine = np.flatnonzero((score > floor[a]) | ((score == floor[a]) & (part.ids[at] < floor_id[a]) & (score > -np.inf)))
                best = fine[_best(score[fine], part.ids[at[fine]], k)]
                out += [(int(own[a]), int(part.ids[at[b]]), int(score[b])) for b in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "score"])

    return answer


def _negatives(dim: int, k: int, least: int, most: int):
    def answer(part: Part, batch: pa.RecordBatch):
        own, label, q, wanted = batch["id"].to_numpy(), batch["label"].to_numpy(), blocks.matrix_of(batch["vector"], dim), batch["positives"].to_pylist()
        rows, out = slice(0, len(part.ids)), []
        other = part.labels[None, :] != label[:, None]
        lower, upper = part.between(q, rows)
        survive = np.zeros(other.shape, bool)
        for i, positives in enumerate(wanted):
            for p in positives:
                survive[i] |= (upper[i] >= max(-(-least * p["score"] // 100), p["floor_score"] if p["floor_score"] is not None else LEAST)) & (lower[i] <= most * p["score"] // 100)
        at, got = part.scores(q, rows, survive & other)
        ids = part.ids[at]
        for i, positives in enumerate(wanted):
            bounds = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in positives]
            lo, hi = min(b[0] for b in bounds), max(b[1] for b in bounds)
            fine = np.flatnonzero((got[i] >= lo) & (got[i] <= hi))
            fine = fine[_best(got[i][fine], ids[fine], len(fine))]
            score = got[i][fine]
            for p, (lo, hi) in zip(positives, bounds, strict=True):
                first = int(np.searchsorted(-score, -hi)) if score.dtype != object else sum(s > hi for s in score)
                for j in range(first, min(first + k, len(score))):
                    if score[j] < lo or (p["floor_score"] is not None and (-score[j], ids[fine[j]]) >= (-p["floor_score"], p["floor_id"])):
                        break
                    out.append((int(own[i]), p["id"], p["score"], int(ids[fine[j]]), int(score[j])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return answer


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its nearest rows of its label: the highest rows of other labels that score between least
    and most hundredths of the positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    scratch = Scratch(vectors.sparkSession)
    placed, dim, parts = blocks.index(blocks.whole_rows(vectors, is_anchor, id_col, vector_col, label), scale, scratch, describe, "binary,double,double")
    rows, hold, anchors = placed.drop("asked"), _hold(dim), blocks.queries(placed)
    floors = {"floor_score": F.lit(None).cast("long"), "floor_id": F.lit(None).cast("long")}
    schema = "anchor_id long, positive_id long, score long"
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    near = scratch.cut(blocks.meet(rows, anchors.withColumns(floors), parts, hold, _positives(dim, positives), schema), "positives")
    kth = near.withColumn("rank", order).filter(F.col("rank") == positives).select(F.col("anchor_id").alias("id"), F.col("score").alias("floor_score"), F.col("positive_id").alias("floor_id"))
    far = blocks.meet(rows, blocks.elsewhere(anchors.join(kth, "id", "left"), parts), parts, hold, _positives(dim, positives), schema)
    found = scratch.cut(near.unionByName(far).withColumn("rank", order).filter(F.col("rank") <= positives).select("anchor_id", "positive_id", "score"), "positives")
    scratch.free(near)

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    order = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))

    def asked(with_floors: DataFrame) -> DataFrame:
        """Anchors with their positives, of which there are few."""
        lists = with_floors.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score", "floor_score", "floor_id")).alias("positives"))
        return anchors.join(lists, "id")

    ask = _negatives(dim, negatives, least, most)
    near = scratch.cut(blocks.meet(rows, asked(found.withColumns(floors)), parts, hold, ask, schema), "negatives")
    kth = near.withColumn("rank", order).filter(F.col("rank") == negatives).select("anchor_id", "positive_id", F.col("negative_score").alias("floor_score"), F.col("negative_id").alias("floor_id"))
    far = blocks.meet(rows, blocks.elsewhere(asked(found.join(kth, ["anchor_id", "positive_id"], "left")), parts), parts, hold, ask, schema)
    out = near.unionByName(far).withColumn("rank", order).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

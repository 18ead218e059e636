"""Exact top k by integer inner product, block by block.

Every block of a part (see blocks) knows the largest and least number of each component. A query's bound of a block is the
sum over its components of what they can give at most there. Blocks are visited in the order of their bounds, each by
all queries that want it next, and scored whole through their vectors, until the bound falls below the query's k-th
score so far; at an equal bound a block is visited only if it has an id that would win the tie. The own part's k-th
row is the first bound at all other parts.

Defined results: vectors that are null, empty, of another length than the most common one, or that hold null or non-finite
numbers take no part; a zero vector scores 0. Of rows with equal ids the one with the greatest vector takes part. Ties go
to the smaller id. With fewer candidates than k all are returned. A score beyond 64 bits is told as the nearest long.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm import blocks
from lorebase.llm.common import Scratch

FOUND = "query_id long, vec_id long, score long"
LEAST, MOST = blocks.LONGS


class Part:
    """A part's vectors in blocks, with the components' extremes of each block."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.last = np.append(self.first[1:], len(block))
        self.most, self.least = np.maximum.reduceat(matrix, self.first), np.minimum.reduceat(matrix, self.first)
        self.least_id = np.minimum.reduceat(ids, self.first)
        self.visited = 0

    def top(self, own: np.ndarray, q: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray):
        """(scores, ids) of each query's k best that beat its floor (greater score, or the same and a lesser id); -inf: none."""
        if not blocks.in_doubles(q, self.matrix):
            return self._by_integers(own, q, k, floor_score, floor_id)
        score, ids = np.repeat(floor_score[:, None], k, axis=1), np.repeat(floor_id[:, None], k, axis=1)  # the floor stands until beaten
        bounds = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(len(q))
        for step in range(order.shape[1]):
            block = order[active, step]
            bound, kth = bounds[active, block], score[active, -1]
            active, block = active[bound >= kth], block[bound >= kth]
            if not len(active):
                break
            tied = (bounds[active, block] == score[active, -1]) & (self.least_id[block] >= ids[active, -1])
            for b in np.unique(block[~tied]):
                asks = active[(block == b) & ~tied]
                rows = slice(self.first[b], self.last[b])
                got, at = q[asks] @ self.matrix[rows].T, self.ids[rows]
                self.visited += got.size
                fine = (got > score[asks, -1:]) | ((got == score[asks, -1:]) & (at[None, :] < ids[asks, -1:]))
                fine &= at[None, :] != own[asks, None]
                better = np.flatnonzero(fine.any(axis=1))
                if len(better):
                    asks, got = asks[better], np.where(fine[better], got[better], -np.inf)
                    every, names = np.concatenate((score[asks], got), axis=1), np.concatenate((ids[asks], np.broadcast_to(at, got.shape)), axis=1)
                    best = np.lexsort((names, -every), axis=1)[:, :k]
                    score[asks], ids[asks] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
        score[(score == floor_score[:, None]) & (ids == floor_id[:, None])] = -np.inf
        return score, ids

    def _by_integers(self, own, q, k, floor_score, floor_id):
        score, ids = np.full((len(q), k), -np.inf, object), np.full((len(q), k), MOST)
        for i, got in enumerate(blocks.products(q, self.matrix)):
            rows = sorted((-x, c) for x, c in zip(got, self.ids.tolist(), strict=True) if c != own[i] and (-x, c) < (-floor_score[i], floor_id[i]))[:k]
            for j, (x, c) in enumerate(rows):
                score[i, j], ids[i, j] = -x, c
        return score, ids


def _answers(dim: int, k: int):
    def hold(table: pa.Table) -> Part:
        return Part(table["id"].to_numpy(), table["block"].to_numpy(), np.vstack([blocks.matrix_of(c, dim) for c in table["vector"].chunks]))

    def answer(part: Part, batch: pa.RecordBatch):
        own, q = batch["id"].to_numpy(), blocks.matrix_of(batch["vector"], dim)
        floor_score = np.array([-np.inf if s is None else float(s) for s in batch["floor_score"].to_pylist()])
        floor_id = np.array([MOST if i is None else i for i in batch["floor_id"].to_pylist()], np.int64)
        score, ids = part.top(own, q, k, floor_score, floor_id)
        found = score != -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, found.sum(axis=1))), pa.array(ids[found]), blocks.as_longs(score[found])], ["query_id", "vec_id", "score"])

    return hold, answer


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """For each row of vectors that is_query holds for: query_id, rank, vec_id, score of its k best by exact inner product."""
    scratch = Scratch(vectors.sparkSession)
    placed, dim, parts = blocks.index(blocks.whole_rows(vectors, is_query, id_col, vector_col), scale, scratch)
    hold_answer = _answers(dim, k)
    asked = blocks.queries(placed).drop("label")
    fields = ["part", "block", "id", "vector"]
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    none = {"floor_score": F.lit(None).cast("long"), "floor_id": F.lit(None).cast("long")}
    near = scratch.cut(blocks.meet(placed.select(fields), asked.withColumns(none), parts, *hold_answer, FOUND), "near")
    floors = near.withColumn("rank", order).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
    far = blocks.meet(placed.select(fields), blocks.elsewhere(asked.join(floors, "id", "left"), parts), parts, *hold_answer, FOUND)
    return near.unionByName(far).withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

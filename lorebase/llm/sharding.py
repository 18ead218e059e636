"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Groups are dealt into cells of bounded size; each cell repeatedly
combines its two partial partitions of largest spread, the one's largest sums with the other's smallest,
until one partial partition remains. Up to NODES cells' partitions are combined in the same way, on the
executors while there are more, and the last ones, NODES times shards numbers at most, by the driver. A slot is a row's number within its shard: rows are numbered
inside the partitions of a written table, and the partitions' counts give each its offset, so no shard
passes through one task.

Defined results: a null text has no bytes and shares the group of the empty text. Repeated rows are rows.
Ties go by cell, then by text digest. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import cut

#: Cells at least, groups in a cell on average at most, and partial partitions that are combined at once at most.
CELLS, GROUPS, NODES = 512, 20_000, 2048
OVERHEAD = 16


def difference(sums: np.ndarray) -> np.ndarray:
    """Combine partial partitions (rows of sums of k parts); returns for each row and part the final part."""
    n, k = sums.shape
    if not n:
        return np.zeros((0, k), np.int64)
    children: dict[int, tuple] = {}
    heap, values = [], {}
    for i in range(n):
        order = np.argsort(sums[i], kind="stable")[::-1]
        values[i] = sums[i][order]
        children[i] = (order,)
        heap.append((int(values[i][-1] - values[i][0]), i))
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = values.pop(a) + values.pop(b)[::-1]  # opposite orders
        order = np.argsort(total, kind="stable")[::-1]
        values[new] = total[order]
        children[new] = (order, a, b)
        heapq.heappush(heap, (int(values[new][-1] - values[new][0]), new))
        new += 1
    out = np.zeros((n, k), np.int64)
    todo = [(heap[0][1], np.arange(k))]  # part at each position of a node's descending sums
    while todo:
        node, parts = todo.pop()
        order = children[node][0]
        before = np.empty(k, np.int64)
        before[order] = parts
        if node < n:
            out[node] = before
        else:
            todo += [(children[node][1], before), (children[node][2], before[::-1])]
    return out


def _cell(shards: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest")
        sums = np.zeros((len(pdf), shards), np.int64)
        sums[:, 0] = pdf.bytes
        return pd.DataFrame({"digest": pdf.digest, "cell": key[0], "part": difference(sums)[:, 0], "bytes": pdf.bytes})

    return run


def combined(pdf: pd.DataFrame, shards: int) -> np.ndarray:
    """The part of the combined partition for each row (cell, part, bytes)."""
    names, at = np.unique(pdf.cell.to_numpy(), return_inverse=True)
    table = np.zeros((len(names), shards), np.int64)
    table[at, pdf.part.to_numpy()] = pdf.bytes.to_numpy()
    return difference(table)[at, pdf.part.to_numpy()] if len(pdf) else np.zeros(0, np.int64)


def _above(shards: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "part"])
        return pd.DataFrame({"cell": pdf.cell, "part": pdf.part, "above": key[0], "above_part": combined(pdf, shards), "bytes": pdf.bytes})

    return run


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    rows = cut(rows, "sizes")
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    cells = max(cells, math.ceil(groups.count() / GROUPS))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int"))
    parts = cut(groups.groupBy("cell").applyInPandas(_cell(shards), "digest binary, cell int, part int, bytes long"), "parts")
    sums = parts.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes"))
    parts = parts.select("digest", "cell", "part")
    while cells > NODES:
        cells = math.ceil(cells / NODES)
        merged = cut(sums.withColumn("above", F.pmod("cell", F.lit(cells))).groupBy("above").applyInPandas(_above(shards), "cell int, part int, above int, above_part int, bytes long"), "merged")
        parts = parts.join(merged, ["cell", "part"]).select("digest", F.col("above").alias("cell"), F.col("above_part").alias("part"))
        sums = merged.groupBy(F.col("above").alias("cell"), F.col("above_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
    last = sums.toPandas()  # NODES times shards rows at most
    last = last.assign(shard=combined(last, shards))[["cell", "part", "shard"]].astype("int32")
    where = docs.sparkSession.createDataFrame(last, "cell int, part int, shard int")
    placed = rows.join(parts, "digest").join(F.broadcast(where), ["cell", "part"])
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("held")), "placed")
    numbers = placed.groupBy("shard", "held").agg(F.count("*").alias("n"))
    numbers = numbers.select("shard", "held", (F.sum("n").over(Window.partitionBy("shard").orderBy("held")) - F.col("n")).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "held").orderBy("doc_id", "size", "text_crc32")) - 1
    return placed.join(numbers, ["shard", "held"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Integer vectors in parts of bounded size, past which queries travel.

A row's part is a hash of its id; a part has PART_NUMBERS vector components on average. Within it rows are put in an order in
which neighbours are alike (halved along the widest coordinate) and cut into blocks of BLOCK rows. Parts are written once;
a query is sent to its own part first, which gives it a bound, and then to all others. So every row moves once a round and every
query once per part, and only rows that beat a query's bound leave a part.

Components are floor(scale * x), kept as doubles, which hold every such number. Products are exact: in doubles
while no sum can reach 2^53, in Python's integers beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import Scratch, binary_chunks, text_buffer

PART_NUMBERS, BLOCK = 1 << 21, 128
#: Queries that meet a part at once.
STEP = 128
EXACT = float(1 << 53)
LONGS = -(1 << 63), (1 << 63) - 1


def whole_rows(vectors: DataFrame, asked: Column, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """id, label, asked, v of the rows that take part; of rows with equal ids the one with the greatest label and vector."""
    v = F.col(vector_col).cast("array<double>")
    label = F.lit(0) if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(asked, F.lit(False)).alias("asked"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    return rows.groupBy("id").agg(F.max(F.struct("label", "asked", "v")).alias("row")).select("id", "row.label", "row.asked", "row.v")


def alike(matrix: np.ndarray) -> np.ndarray:
    """An order of the rows in which each run of BLOCK is alike."""
    todo, done = [np.arange(len(matrix))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        axis = matrix[rows].var(axis=0).argmax()
        rows = rows[np.argsort(matrix[rows, axis], kind="stable")]
        middle = -(-len(rows) // (2 * BLOCK)) * BLOCK
        todo += [rows[middle:], rows[:middle]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(text_buffer(column)[0], np.float64).reshape(-1, dim)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal rows."""
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _placed(dim: int, scale: float, describe: Callable | None):
    """Rows of a part in blocks; describe(matrix) gives further columns of a block's rows."""

    def settle(part, held):
        ids, labels, asked = (np.concatenate([h[i] for h in held]) for i in range(3))
        matrix = np.floor(scale * np.concatenate([h[3] for h in held]))
        block = 0
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            own = own[alike(matrix[own])]
            for lo in range(0, len(own), BLOCK):
                rows = own[lo : lo + BLOCK]
                values = pa.array([part] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array(ids[rows]), pa.array(labels[rows]), pa.array(asked[rows])
                more = describe(matrix[rows]) if describe else []
                yield pa.RecordBatch.from_arrays([*values, binary_chunks(matrix[rows].ravel(), np.arange(len(rows) + 1) * dim, 8), *more], names=["part", "block", "id", "label", "asked", "vector", *[f"more{i}" for i in range(len(more))]])
                block += 1

    def run(batches):
        part, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()[:, None]
            for lo, hi in runs(keys):
                if held and keys[lo, 0] != part:
                    yield from settle(part, held)
                    held = []
                part, piece = int(keys[lo, 0]), batch.slice(lo, hi - lo)
                held.append((piece.column(1).to_numpy(), piece.column(2).to_numpy(), piece.column(3).to_numpy(zero_copy_only=False), piece.column(4).flatten().to_numpy().reshape(-1, dim)))
        if held:
            yield from settle(part, held)

    return run


def index(rows: DataFrame, scale: float, scratch: Scratch, describe: Callable | None = None, schema: str = "") -> tuple[DataFrame, int, int]:
    """(part, block, id, label, asked, vector and describe's columns; dimension; number of parts); dimension 0: no row takes part.

    Vectors of another length than the most common one (ties: the shorter) take no part. describe(dim): called on the driver.
    """
    rows = scratch.cut(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (common[0]["dim"], common[0]["count"]) if common else (0, 0)
    parts = max(1, -(-n * dim // PART_NUMBERS))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 16)
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    dealt = rows.filter(F.size("v") == dim).select(part, "id", "label", "asked", "v").repartition(tasks, "part").sortWithinPartitions("part", "id")
    names = [f"more{i} {t}" for i, t in enumerate(schema.split(","))] if schema else []
    out = scratch.cut(dealt.mapInArrow(_placed(dim, scale, describe(dim) if describe else None), ", ".join(["part int, block int, id long, label long, asked boolean, vector binary", *names])), "parts")
    scratch.free(rows)
    return out, dim, parts


def queries(placed: DataFrame) -> DataFrame:
    return placed.filter("asked").select("part", "id", "label", "vector")


def elsewhere(asked: DataFrame, parts: int) -> DataFrame:
    """The queries at every part but their own."""
    return asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).filter("at <> part").withColumn("part", F.col("at").cast("int")).drop("at")


def meet(placed: DataFrame, asked: DataFrame, parts: int, hold: Callable, answer: Callable, schema: str) -> DataFrame:
    """answer(hold(a part's rows), queries) for every piece of queries at every part.

    Both see record batches with the columns of placed and asked in one row, so that one sort brings a part's rows before its queries.
    """
    own = [c for c in asked.columns if c not in placed.columns]
    types = dict(asked.dtypes)
    left = placed.withColumns({c: F.lit(None).cast(types[c]) for c in own}).withColumn("side", F.lit(0))
    right = asked.withColumn("side", F.lit(1))
    rest = [c for c in placed.columns if c not in ("part", "block", "id")]
    columns = ["part", "side", "block", "id", *rest, *own]
    met = left.select(columns).unionByName(right, allowMissingColumns=True).select(columns)
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 16)
    met = met.repartition(tasks, "part").sortWithinPartitions("part", "side", "block", "id")

    def run(batches):
        part, held, ready = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(2)]) if batch.num_rows else np.zeros((0, 2), np.int64)
            for lo, hi in runs(keys):
                if keys[lo, 0] != part:
                    part, held, ready = keys[lo, 0], [], None
                if keys[lo, 1] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if held and ready is None:
                    ready = hold(pa.Table.from_batches(held).combine_chunks())
                    held = []
                for at in range(lo, hi, STEP) if ready is not None else ():
                    yield from answer(ready, batch.slice(at, min(STEP, hi - at)))

    return met.mapInArrow(run, schema)


def in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every sum of products of a's and b's rows is exact in doubles."""
    return not len(a) or not len(b) or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b: doubles, or Python's integers where they are not exact."""
    if in_doubles(a, b):
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
    return whole[0] @ whole[1].T


def as_longs(values) -> pa.Array:
    """Scores as 64-bit integers; one beyond them is told as the nearest."""
    return pa.array([min(max(int(x), LONGS[0]), LONGS[1]) for x in values], pa.int64())

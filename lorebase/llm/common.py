"""What several operators share: the shared folder, text kernels over Arrow buffers, components.

The text kernels see a batch of documents as one byte buffer with offsets, so that numpy works
on the whole batch at once and no Python object is made per word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a kernel works on at once; a longer text is taken alone.
PASS_BYTES = 1 << 20
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one where none is set and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "" not in _LOCAL:
        _LOCAL[""] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL[""], ignore_errors=True)
    return f"file://{_LOCAL['']}"


class Scratch:
    """Tables written to the shared folder: each ends a lineage and survives lost executors.

    free deletes the folders of tables that no unfinished plan reads any more, so that a long job
    holds only what its next steps need.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again."""
        path = f"{shared_dir(self.spark)}/lorebase-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.held.pop(id(table))
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def keep(self, *tables: DataFrame) -> None:
        """Free all other tables."""
        kept = {id(t) for t in tables}
        self.free(*[t for k, (t, _) in list(self.held.items()) if k not in kept])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again; the table stays until the folder is cleared."""
    return Scratch(df.sparkSession).cut(df, name)


_STATE: dict = {}


def worker_state(key, make: Callable):
    """make(), remembered by this Python worker until a task asks for another key.

    Workers outlive stages, so that without this rule the tables of every kernel they ever ran would add up.
    """
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _STATE[key] = make()
    return _STATE[key]


def passes(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have limit bytes at most together, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes.astype(np.int64)), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone, a null text as empty; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple:
    """(64-bit hash of each word with A-Z lower-cased, number of the first word of each document and the total).

    places: also the first byte of each word and the byte after it. Works on blocks of PASS_BYTES, cut where no word is.
    """
    n, cuts, parts = len(data), [0], []
    edges = np.zeros(n + 1, bool)
    edges[offsets] = True  # a word ends with its document
    while cuts[-1] < n:
        at = cuts[-1] + PASS_BYTES
        while at < n and not edges[at] and not _SPACE[data[at]]:
            at += 1
        cuts.append(min(at, n))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        parts.append(_word_hashes(data[lo:hi], edges[lo:hi], lo))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(starts, offsets)
    return (hashes, first, starts, ends) if places else (hashes, first)


def _word_hashes(data: np.ndarray, edges: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edges[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), starts, starts
    where = np.flatnonzero(inside)
    at = where - starts[np.cumsum(begins[where]) - 1]
    values = (_LOWER[data[where]].astype(U64) + U64(1)) * constants(int(at.max()) + 1, 1)[at]
    first = np.searchsorted(where, starts)
    return mix(np.add.reduceat(values, first)), starts + base, where[np.append(first[1:], len(where)) - 1] + 1 + base


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): per document the sorted distinct hashes of its shingles of width words.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words, first = word_hashes(data, offsets)
    weights = constants(width, 2)
    counts = np.diff(first)
    n = len(words) - width + 1
    rolled = sum(words[i : i + n] * weights[i] for i in range(width)) if n > 0 else np.zeros(0, U64)
    rolled = mix(rolled) if n > 0 else rolled
    parts, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for i, c in enumerate(counts):
        lo = first[i]
        if c >= width:
            own = np.sort(rolled[lo : lo + c - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif c:
            own = mix(np.array([(words[lo : lo + c] * weights[:c]).sum() + U64(c)], U64) ^ U64(0x5555))
        else:
            own = words[:0]
        parts.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), bounds


class ChunkMemory:
    """Ids of byte chunks; solve(chunks) is asked once for each different chunk, told by a 64-bit hash."""

    def __init__(self, solve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.solve, self.most = solve, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def __call__(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks of data, number of ids of each); chunks begin at begin and cover all of data."""
        if len(self.keys) > self.most:
            self.clear()
        size = np.diff(begin, append=len(data))
        at = np.arange(len(data)) - np.repeat(begin, size)
        keys = mix(np.add.reduceat((data.astype(U64) + U64(1)) * constants(int(size.max()), 4)[at], begin))
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(np.append(self.keys, U64(0))[where] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            flat, count = self.solve([raw[begin[f] : begin[f] + size[f]] for f in first[new]])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.used : self.used + len(flat)] = flat
            places = self.used + np.cumsum(count) - count
            self.used += len(flat)
            self.keys, self.at, self.n = (np.insert(old, where[new], x) for old, x in ((self.keys, unique[new]), (self.at, places), (self.n, count)))
            where = np.searchsorted(self.keys, unique)
        count = self.n[where][back].astype(np.int64)
        return gathered(self.pool, self.at[where][back], count), count


def gathered(pool: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs pool[place:place + count], one after the other."""
    ends = np.cumsum(count)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(place - ends + count, count)]


def binary_chunks(flat: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    """An Arrow binary column: row i holds flat[bounds[i]:bounds[i+1]] as bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of edges reaches; the table belongs to scratch.

    Every round passes the smallest label to neighbours and then lets each label jump to its own
    label, so long chains need a logarithmic number of rounds. Rounds are written to the shared folder.
    """
    both = scratch.cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("next"))).distinct(), "edges")
    labels = scratch.cut(both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = scratch.cut(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("jump", "component")).alias("component"), "was"), "labels")
        changed = new.filter("component <> was").limit(1).count()
        scratch.free(labels)
        labels = new
        if not changed:
            scratch.free(both)
            return labels


#: Bits of a sieve at most (8 MB in all).
SIEVE_BITS = 1 << 26


class Sieve:
    """Bit maps of the hashes of a written table's keys: tells, without a shuffle, which rows of another table may have one of them.

    A row that it lets pass still has to be joined; a row that it holds back has none of the keys. Its size is
    bounded by SIEVE_BITS; with very many keys it holds fewer rows back, which costs time but changes no result.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        n = keys.count()
        self.bits = min(SIEVE_BITS, 1 << max(15, (16 * n).bit_length()))
        place = self._place([F.col(c) for c in columns])
        self.maps = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("sieve_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("sieve_map"))

    def _place(self, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def split(self, df: DataFrame, *columns: Column) -> tuple[DataFrame, DataFrame]:
        """(rows of df that may have one of the keys, rows that have none); columns: the keys' counterparts."""
        place = self._place(list(columns))
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("sieve_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
        # 4 KB for each of SIEVE_BITS / 32768 rows at most.
        tested = df.withColumn("sieve_key", F.bitmap_bucket_number(place)).join(F.broadcast(self.maps), F.col("sieve_key") == F.col("sieve_bucket"), "left").withColumn("sieve_hit", hit)
        return tuple(tested.filter(keep).select(*df.columns) for keep in (F.col("sieve_hit"), ~F.col("sieve_hit")))

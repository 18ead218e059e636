"""Packing token ids into fixed windows: concatenate and cut.

Pass 1 turns every text into token ids, closes each document with an end id, and keeps the running
start of every document within its partition; the ids are written to the shared folder. The totals of
the partitions, one number each, are summed to global offsets. Pass 2 cuts the one long sequence of
ids at every multiple of the window and returns a boundary record per piece. No row is shuffled.

Only the last window can be short; all others are full, so padding is less than one window.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as they
stand in the table. An empty table gives no pieces. Documents lie in the table's own order, each id in
exactly one piece. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import ChunkMemory, Scratch, binary_chunks, passes, text_buffer, whole, worker_state

#: Different chunks whose ids a worker remembers (about 40 bytes each); beyond it starts anew.
REMEMBERED = 400_000
_SIMPLE = re.compile("( ?)[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14), *range(28, 32)]] = True
#: Bytes that surely begin what is no white space.
_SOLID = np.zeros(256, bool)
_SOLID[:128] = ~_SPACE[:128]
_SOLID[0xC3] = True


class Encoder:
    """Ids of whole texts, each different chunk encoded once.

    The vocabulary's pattern always breaks before a space that a solid character follows, around a
    single line feed between solid characters, and between a letter or digit and .,;:!? after it. A
    text is the sum of its chunks between such breaks, so its ids are theirs in turn.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.memory = ChunkMemory(self._encode, REMEMBERED)

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        chunks, out, rest = [x.decode() for x in raw], [], []
        for i, chunk in enumerate(chunks):
            if _SIMPLE.fullmatch(chunk):
                out.append([t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))])
            else:
                out.append([])
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        count = np.fromiter(map(len, out), np.int32, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(count.sum())), count

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of the first id of each text and the total)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        n = len(data)
        start = np.zeros(n, bool)
        solid = _SOLID[data]
        feed = data[1:-1] == 10
        start[:-1] = (data[:-1] == 32) & solid[1:]
        start[1:] |= _TAIL[data[1:]] & _ALNUM[data[:-1]]
        lone = np.flatnonzero(feed & solid[:-2] & (data[:-2] < 128) & solid[2:]) + 1
        start[lone] = start[lone + 1] = True
        start[offsets[:-1][offsets[:-1] < n]] = True
        begin = np.flatnonzero(start)
        ids, count = self.memory(data, begin)
        return ids, np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begin, offsets)]


def _tokens(path: str, end_id: int):
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        encoder = worker_state(("packing", path), lambda: Encoder(path))
        for batch in passes(batches, "text"):
            ids, bounds = encoder(*text_buffer(batch.column("text")))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            n = np.diff(bounds)
            wide = np.uint16 if not len(ids) or ids.max() < 65536 else np.uint32
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(at + bounds[:-1]), pa.array(n), binary_chunks(ids.astype(wide), bounds, wide().itemsize)], ["part", "doc_id", "part_start", "n", "ids"])
            at += int(bounds[-1])

    return run


def _pieces(window: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            doc, first, count = (batch.column(c).to_numpy() for c in range(3))
            data, at = text_buffer(batch.column(3))
            rows = []
            for i in range(len(doc)):
                n, begin = int(count[i]), int(first[i])
                raw = data[at[i] : at[i + 1]]
                ids = raw.view(np.uint16).astype(np.uint32) if len(raw) == 2 * n else raw.view(np.uint32)
                lo = 0
                while lo < n:
                    sequence, offset = divmod(begin + lo, window)
                    hi = min(n, lo + window - offset)
                    rows.append((doc[i], lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, sequence, offset))
                    lo = hi
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file that every executor can read; window: ids in a sequence.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tokens = Scratch(docs.sparkSession).cut(whole(docs, id_col, text_col).mapInArrow(_tokens(path, end_id), "part int, doc_id long, part_start long, n long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    # A number for each partition of the scan; a million partitions are 12 MB.
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("first"), "n", "ids")
    return placed.mapInArrow(_pieces(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

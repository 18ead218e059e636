"""SentencePiece encoding and decoding by Unigram Viterbi over a double-array trie.

The pieces of a public model lie in a double-array trie (base and check arrays over bytes). A text gets the
word-start mark in front and in place of every space; the best segmentation by the sum of piece scores
follows from dynamic programming over all pieces that the trie finds at each byte. What no piece covers falls
back to byte pieces. As no piece has a mark after another character, the best segmentation of a text is that of
its marked words in turn: each different word is solved once, all new short words of one length together. The pieces
of long ones (unbroken strings, scripts without spaces) are found from all their places at once, and plain lists take
the best of them.

Models of the merge kind rank pieces instead of scoring them; a piece of rank r then gets the log score
-log(r + 2), the shape of a frequency list. Given log scores are used as they are.

Defined results: a null or empty text has no ids. Decoding gives every text back exactly: inside, the mark is
the byte 255, which no text holds, so the character U+2581 of a text is encoded by its bytes. Ids that are no
encoded text may decode to replacement characters. Ties go to the longer last piece. Repeated rows agree. Very
long texts are taken whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lorebase.llm.common import ChunkMemory, binary_chunks, gathered, passes, text_buffer, whole, worker_state

MARK = "▁"
_MARK_BYTE = 255
#: Log score of a byte piece, worse than any piece.
BYTE_SCORE = -30.0
#: Different words whose ids a worker remembers (about 40 bytes each), and bytes of words that are solved together.
REMEMBERED, TOGETHER = 400_000, 1 << 18
#: Bytes up to which words of one length are solved together, and places of longer ones whose pieces are found at once.
SHORT, PLACES = 32, 1 << 16
#: Ids that a worker remembers, beyond which it starts anew.
MOST_IDS = 16 * REMEMBERED


class DoubleArray:
    """base and check arrays: from node s by byte b to t = base[s] + b + 1 if check[t] == s; value[t]: piece or -1."""

    def __init__(self, pieces: list[tuple[bytes, int]]):
        size = 4 * sum(len(k) for k, _ in pieces) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        tree: dict = {}
        for key, number in pieces:
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = number
        free = wide = 258  # so that every first place fits
        todo = [(0, tree)]
        for s, node in todo:
            children = sorted(b for b in node if b >= 0)
            value[s] = node.get(-1, -1)
            if not children:
                continue
            while check[free] >= 0:
                free += 1
            start = max(1, (free if len(children) == 1 else max(free, wide)) - children[0] - 1)
            while any(check[start + b + 1] >= 0 for b in children):
                start += 1
            if len(children) > 1:
                wide = start + children[0] + 1  # earlier gaps are left to nodes with one child
            base[s] = start
            for b in children:
                check[start + b + 1] = s
                todo.append((start + b + 1, node[b]))
        used = max(i for i, c in enumerate(check) if c >= 0) + 258
        self.base, self.check, self.value = (np.array(x[:used], np.int32) for x in (base, check, value))


class Model:
    """names, scores and kinds of the ids, and the trie; arrays only, so that it can be broadcast."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        given = np.array([model.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and MARK not in self.names[i].lstrip(MARK)]
        ranked = all(given[i] == round(given[i]) for i in normal)
        self.scores = np.full(n, BYTE_SCORE)
        self.scores[normal] = [-math.log(max(0.0, -given[i]) + 2) if ranked else given[i] for i in normal]
        self.trie = DoubleArray([(_marked(self.names[i]), i) for i in normal])
        raw = [_marked(name) for name in self.names]
        for b, i in self.byte_ids.items():
            raw[i] = bytes([b])
        self.raw_n = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.of_byte = np.array([self.byte_ids[b] for b in range(256)], np.uint32)

    def solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the best segmentations of all words, number of ids of each)."""
        sizes = np.array([len(w) for w in words])
        count, parts = np.zeros(len(words), np.int32), [np.zeros(0, np.uint32)] * len(words)
        for n in np.unique(sizes[sizes <= SHORT]).tolist():
            own = np.flatnonzero(sizes == n)
            step = max(1, TOGETHER // n)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                for i, ids in zip(part.tolist(), self._solve(np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)), strict=True):
                    parts[i], count[i] = ids, len(ids)
        own = np.flatnonzero(sizes > SHORT)
        for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own]) // TOGETHER)) + 1) if len(own) else []:
            for i, ids in zip(part.tolist(), self._solve_long([words[i] for i in part]), strict=True):
                parts[i], count[i] = ids, len(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), count

    def _solve(self, words: np.ndarray) -> list[np.ndarray]:
        """Viterbi over the bytes of words of one length: from each place the trie is followed in all words that are still in it."""
        m, n = words.shape
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        start, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        for i in range(n):
            self._better(best, start, piece, i, i + 1, np.arange(m), np.full(m, -1), best[i] + BYTE_SCORE)
            rows, node = np.arange(m), np.zeros(m, np.int64)
            for j in range(i, n):
                to = base[node] + words[rows, j] + 1
                inside = check[np.minimum(to, len(check) - 1)] == node
                inside &= to < len(check)
                rows, node = rows[inside], to[inside]
                if not len(rows):
                    break
                found = value[node]
                ends = found >= 0
                if ends.any():
                    at = rows[ends]
                    self._better(best, start, piece, i, j + 1, at, found[ends], best[i, at] + self.scores[found[ends]])
        ids, place, out = np.zeros((m, n), np.uint32), np.full(m, n), np.zeros(m, np.int64)
        while (todo := np.flatnonzero(place)).size:
            p, s = piece[place[todo], todo], start[place[todo], todo]
            ids[todo, out[todo]] = np.where(p >= 0, p, self.of_byte[words[todo, s]])
            out[todo] += 1
            place[todo] = s
        return [row[:k][::-1] for row, k in zip(ids, out.tolist(), strict=True)]

    def _pieces(self, raw: np.ndarray, begin: int, until: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces from places begin to until on, no further than the ends of their words; ascending."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        rows = begin + np.flatnonzero(ends > np.arange(begin, until))
        node, depth, found = np.zeros(len(rows), np.int64), 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        while len(rows):
            to = base[node] + raw[rows + depth] + 1
            inside = check[np.minimum(to, len(check) - 1)] == node
            inside &= to < len(check)
            rows, node, depth = rows[inside], to[inside], depth + 1
            piece = value[node]
            hit = piece >= 0
            found.append((rows[hit], rows[hit] + depth, piece[hit]))
            further = rows + depth < ends[rows - begin]
            rows, node = rows[further], node[further]
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order]

    def _solve_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The same for words of any length, one place after the other: each place gives its best score to the ends of its pieces."""
        raw = np.frombuffer(b"\0".join(words), np.uint8)  # the place between two words is the end of the first
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        n = len(raw)
        # The piece that leads to a place, -1 for a byte, and where it starts.
        which, came = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int64)
        over: list[float] = []  # best scores of places behind a part, from pieces within it
        for lo in range(0, n, PLACES):
            hi = min(n, lo + PLACES)
            places = np.arange(lo, hi)
            until = ends[np.searchsorted(ends, places)]
            start, end, piece = self._pieces(raw, lo, hi, until)
            plain = until > places
            plain[start[(end == start + 1) & (self.scores[piece] > BYTE_SCORE)] - lo] = False  # a byte piece would lose
            plain = places[plain]
            order = np.argsort(np.concatenate((plain, start)), kind="stable")  # a place's byte comes before its pieces
            start, end, piece = (np.concatenate(x)[order] for x in ((plain, start), (plain + 1, end), (np.full(len(plain), -1, np.int32), piece)))
            score = np.where(piece >= 0, self.scores[piece], BYTE_SCORE)
            size = int(max(end.max(initial=hi), hi, lo + len(over))) - lo + 1
            best, edge = over + [-math.inf] * (size - len(over)), [-1] * size
            for e in [0] * (lo == 0) + (ends[(ends >= lo - 1) & (ends < hi)] + 1).tolist():
                if e - lo < size:
                    best[e - lo] = 0.0  # a word's first place
            for k, s, e, x in zip(range(len(start)), (start - lo).tolist(), (end - lo).tolist(), score.tolist(), strict=True):
                x += best[s]
                if x > best[e]:
                    best[e], edge[e] = x, k
            edge = np.array(edge)
            at = np.flatnonzero(edge >= 0)
            which[lo + at], came[lo + at] = piece[edge[at]], start[edge[at]]
            over = best[hi - lo :]
        out = []
        for word, end in zip(words, ends.tolist(), strict=True):
            lo, at, taken = end - len(word), len(word), []
            back = (came[lo : end + 1] - lo).tolist()
            while at:
                taken.append(at)
                at = back[at]
            taken = np.array(taken[::-1], np.int64) + lo
            piece = which[taken]
            out.append(np.where(piece >= 0, piece, self.of_byte[raw[taken - 1]]).astype(np.uint32))
        return out

    @staticmethod
    def _better(best, start, piece, i: int, j: int, rows, found, score) -> None:
        """Let the pieces found from place i end at place j in the rows where they score better."""
        better = score > best[j, rows]
        rows = rows[better]
        best[j, rows], start[j, rows], piece[j, rows] = score[better], i, found[better]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, their bounds) of ids, cut into texts by bounds; the first mark of each is left out."""
        count = self.raw_n[ids]
        raw = gathered(self.raw, self.raw_at[ids], count)
        ends = np.concatenate(([0], np.cumsum(count)))[bounds]
        first = ends[:-1][np.diff(ends) > 0]
        keep = np.ones(len(raw), bool)
        keep[first] = raw[first] != _MARK_BYTE
        out = np.where(raw == _MARK_BYTE, np.uint8(32), raw)[keep]
        return out, np.concatenate(([0], np.cumsum(keep)))[ends]


def _marked(name: str) -> bytes:
    return b"".join(bytes([_MARK_BYTE]) if c == MARK else c.encode() for c in name)


class Encoder:
    """A model with a memory of the words that it has solved."""

    def __init__(self, model: Model):
        self.model, self.memory = model, ChunkMemory(model.solve, REMEMBERED)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        marked = np.insert(np.where(data == 32, np.uint8(_MARK_BYTE), data), offsets[full], np.uint8(_MARK_BYTE))
        begins = offsets[full] + np.arange(len(full))
        mark = marked == _MARK_BYTE
        word = mark.copy()
        word[1:] &= ~mark[:-1]
        word[begins] = True
        begin = np.flatnonzero(word)
        if self.memory.used > MOST_IDS:
            self.memory.clear()
        ids, count = self.memory(marked, begin)
        bounds = np.zeros(len(offsets), np.int64)
        bounds[full + 1] = np.add.reduceat(count, np.searchsorted(begin, begins))
        return ids, np.cumsum(bounds)


def _encoder(shared) -> Encoder:
    return worker_state(("pieces", shared.id), lambda: Encoder(shared.broadcast.value))


def _encode(shared):
    def run(batches):
        for batch in passes(batches, "text"):
            ids, bounds = _encoder(shared)(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), binary_chunks(ids, bounds, 4)], ["doc_id", "ids"])

    return run


def _decode(shared):
    def run(batches):
        for batch in passes(batches, "ids"):
            raw, offsets = text_buffer(batch.column("ids"))
            data, bounds = _encoder(shared).model.decode(raw.view(np.uint32), offsets // 4)
            whole_bytes = data.tobytes()
            texts = [whole_bytes[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


class _Shared:
    """A broadcast model with a number by which a worker knows that it has it already."""

    def __init__(self, df: DataFrame, path: str | None):
        path = path or public_tokenizers.path("piece_bpe_32k.model")
        self.broadcast, self.id = df.sparkSession.sparkContext.broadcast(Model(path)), path  # the vocabulary's size alone


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian uint32 bytes) per row of docs."""
    return whole(docs, id_col, text_col).mapInArrow(_encode(_Shared(docs, model_path)), "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_Shared(encoded, model_path)), "doc_id long, text string")


def _digest(shared):
    def run(batches):
        for batch in passes(batches, "text"):
            encoder = _encoder(shared)
            data, offsets = text_buffer(batch.column("text"))
            ids, bounds = encoder(data, offsets)
            back, ends = encoder.model.decode(ids, bounds)
            first = int(encoder.model.of_byte.min())
            is_byte = np.concatenate(([0], np.cumsum((ids >= first) & (ids < first + 256))))
            raw, decoded, own = ids.tobytes(), back.tobytes(), data.tobytes()
            spans = list(zip(*(x.tolist() for x in (bounds[:-1], bounds[1:], ends[:-1], ends[1:], offsets[:-1], offsets[1:])), strict=True))
            columns = [
                np.diff(bounds),
                np.diff(is_byte[bounds]),
                [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b, *_ in spans],
                [hashlib.sha256(decoded[a:b]).hexdigest() for _, _, a, b, *_ in spans],
                [decoded[a:b] == own[c:d] for _, _, a, b, c, d in spans],
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_ids", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Encodes and decodes every row: doc_id, n_ids, n_bytes (byte ids), ids_sha256, decoded_sha256, round_trip."""
    return whole(docs, id_col, text_col).mapInArrow(_digest(_Shared(docs, model_path)), "doc_id long, n_ids long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean")

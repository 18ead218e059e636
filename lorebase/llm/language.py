"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. The probability of a word
sums over all its segmentations into pieces (forward algorithm), and a text's is the product over its
words, as no piece reaches over a word's start. Piece probabilities are fitted by expectation
maximisation on a bounded sample of labelled rows: expected piece counts come from forward and
backward sums on the executors, and only one number per piece and language reaches the driver.

Defined results: `und` with score 0 for a text that is null, empty or without letters, and for every
text if there is no labelled row. Ties go to the alphabetically first language. Words count lower-cased
and without other characters, at any length: long ones are summed with scaled steps, so nothing underflows.
Each row is predicted from its text alone, so repeated rows agree. Extra columns are ignored; keep_identified
keeps them, needs the columns named by lang_col and text_col, and drops the rows it finds no language for.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import U64, Scratch, mix, passes, text_buffer, whole, word_hashes, worker_state

#: Labelled rows of each language that the model is fitted on, at most (about).
SAMPLE_ROWS = 1500
ITERATIONS = 3
#: Letters up to which plain products stay far above the least double (UNKNOWN to that power is 1e-297).
PLAIN = 32
#: Words of one length that are summed together; letters of longer words that are summed together, and about how many of them one lane has.
TOGETHER, HELD, LANE = 2048, 1 << 15, 64
#: Letters of the parts in which longer words are learned from (they are predicted whole).
LEARNED = 32
#: Probability of a character that the vocabulary lacks, and what is added to each expected count.
UNKNOWN, SMOOTH = 1e-9, 0.05
#: Words whose scores a worker remembers; beyond it starts anew.
REMEMBERED = 400_000
_RUN = re.compile(r"[^\W\d_]+")
_BASE = U64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Pieces that consist of letters, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted({p.lower() for p in pieces if p.lstrip("▁").isalpha() and p.count("▁") <= 1} | {"▁"})


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points; any part's hash follows from two of them."""
    out = np.zeros((len(codes), codes.shape[1] + 1), U64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + mix(codes[:, i].astype(U64) + U64(1))
    return out


def _hash_long(codes: np.ndarray) -> np.ndarray:
    """The same of one long row, without a step per code point: the base is odd, so it has an inverse."""
    n = len(codes)
    powers, inverse = (np.cumprod(np.concatenate(([U64(1)], np.full(n, x, U64)))) for x in (_BASE, U64(pow(int(_BASE), -1, 1 << 64))))
    return np.concatenate(([U64(0)], np.cumsum(mix(codes.astype(U64) + U64(1)) * inverse[1:]))) * powers


class Pieces:
    """Finds every piece in every word of equal length at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        keys = np.zeros(self.size, U64)
        for n in {len(p) for p in pieces}:
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            keys[own] = _hash(np.array([[ord(c) for c in pieces[i]] for i in own]))[:, -1]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces))
        self.seen = np.zeros(1 << 20, bool)  # of a piece's hash, the low bits
        self.seen[self._low(self.keys)] = True

    def _low(self, keys: np.ndarray) -> np.ndarray:
        return (keys & U64(len(self.seen) - 1)).astype(np.int64)

    def matches(self, words: list[str]):
        """(start, end, piece number) arrays for words of one length; size: no piece, size + 1: unknown character."""
        codes = np.array([[ord(c) for c in w] for w in words])
        prefix, n = _hash(codes), codes.shape[1]
        power = np.cumprod(np.concatenate(([U64(1)], np.full(n, _BASE, U64))))
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                key = prefix[:, end] - prefix[:, start] * power[end - start]
                at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
                found = np.where(self.keys[at] == key, self.order[at], self.size + (end - start == 1))
                if end - start == 1 or (found < self.size).any():
                    yield start, end, found


    def ends(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """Piece that ends at each position of one word, by the piece's length; size + 1: unknown character, size + 2: none."""
        prefix, out = _hash_long(codes), {}
        powers = np.cumprod(np.full(self.longest, _BASE, U64))
        for size in range(1, min(self.longest, len(codes)) + 1):
            key = prefix[size:] - prefix[:-size] * powers[size - 1]
            found = np.full(len(codes), self.size + (1 if size == 1 else 2))
            where = np.flatnonzero(self.seen[self._low(key)])
            key = key[where]
            at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
            same = self.keys[at] == key
            found[where[same] + size - 1] = self.order[at[same]]
            if (found < self.size + 2).any():
                out[size] = found
        return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _padded(probabilities: np.ndarray) -> np.ndarray:
    langs = probabilities.shape[1]
    return np.vstack((probabilities, np.zeros((1, langs)), np.full((1, langs), UNKNOWN)))


def _edges(pieces: Pieces, words: list[str]) -> list:
    return list(pieces.matches(words))


def _ahead(edges: list, n: int, table: np.ndarray, words: int) -> np.ndarray:
    """Summed probability of the first 0 to n characters of each word, in each language."""
    alpha = np.zeros((n + 1, words, table.shape[1]))
    alpha[0] = 1
    for start, end, found in edges:
        alpha[end] += alpha[start] * table[found]
    return alpha


def _ahead_logs(edges: list, n: int, logs: np.ndarray, words: int) -> np.ndarray:
    """The same in logarithms."""
    alpha = np.full((n + 1, words, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for start, end, found in edges:
        np.logaddexp(alpha[end], alpha[start] + logs[found], out=alpha[end])
    return alpha


def _log(table: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(table)


def _long(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the summed probability of words of any length, in each language.

    The letters of all words are cut into lanes, where few pieces cross, and the lanes take their steps together.
    As a lane does not know the sums before it, it has a row for each place from which a piece may cross its start,
    as if only that place had a sum, of 1. Lanes are then put together one after the other.
    """
    sizes, langs, back = np.array([len(w) for w in words]), table.shape[1], pieces.longest
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out, state = np.zeros((len(words), langs)), np.full((back, langs), -np.inf)
    for lo in range(0, len(codes), HELD):
        hi, before = min(len(codes), lo + HELD), min(lo, back - 1)  # a piece may reach back over the part's start
        owner = np.searchsorted(bounds, np.arange(lo - before, hi), "right") - 1
        inside = np.arange(lo - before, hi) - bounds[owner] + 1
        reach, deep = pieces.ends(codes[lo - before : hi]), np.zeros(before + hi - lo + 1, np.int64)
        for size, found in reach.items():
            found[(inside < size) | (found > pieces.size + 1)] = pieces.size  # no probability
            ends = np.flatnonzero(found < pieces.size) + 1
            for d in range(1, size):
                deep[ends - d] = np.maximum(deep[ends - d], size - d)  # how far before a place a piece starts that crosses it
        first, deep = owner[before], deep[before:]
        deep[0] = min(back - 1, lo - bounds[first])
        cuts = _cuts(np.concatenate(([lo], bounds[(bounds > lo) & (bounds < hi)], [hi])) - lo, deep, back)
        begin, length, rows = cuts[:-1], np.diff(cuts), deep[cuts[:-1]] + 1
        sums = _lanes(reach, table, begin + before, length, rows, back)
        word, at = owner[before + begin], np.cumsum(rows) - rows
        starts, ends = lo + begin == bounds[word], lo + begin + length == bounds[word + 1]
        alone = starts & ends
        out[word[alone]] = sums[at[alone], 0]
        for i in np.flatnonzero(~alone).tolist():
            own = sums[at[i] : at[i] + rows[i]]
            state = own[0] if starts[i] else np.logaddexp.reduce(state[: rows[i], None] + own, axis=0)
            if ends[i]:
                out[word[i]] = state[0]
    return out


def _cuts(bounds: np.ndarray, deep: np.ndarray, back: int) -> np.ndarray:
    """Bounds of lanes: those of words, and in long words the places near every LANE letters that the shortest pieces cross."""
    lane = max(LANE, 4 * back)
    count = np.maximum(np.diff(bounds) // lane - 1, 0)
    near = np.repeat(bounds[:-1], count) + lane * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1) - lane // 4
    best = deep[near[:, None] + np.arange(lane // 2)].argmin(axis=1)
    return np.unique(np.concatenate((bounds, near + best)))


def _lanes(reach: dict, table: np.ndarray, begin: np.ndarray, length: np.ndarray, rows: np.ndarray, back: int) -> np.ndarray:
    """log of the sums at the last places of each lane (last first, back of them), for each of its rows: row r has 1 at r places before its start."""
    lane = np.repeat(np.arange(len(rows)), rows)
    entry = np.arange(len(lane)) - np.repeat(np.cumsum(rows) - rows, rows)
    order = np.argsort(-length[lane], kind="stable")
    lane, entry = lane[order], entry[order]
    at, size = begin[lane], length[lane]
    going = len(lane) - np.searchsorted(size[::-1], np.arange(int(size[0])), "right")  # rows with a letter t
    sums, total = np.zeros((back + int(size[0]), len(lane), table.shape[1])), np.zeros((len(lane), table.shape[1]))
    sums[back - 1 - entry, np.arange(len(lane))] = 1
    none = len(table) - 2
    for t, n in enumerate(going.tolist()):
        now = sums[back + t, :n]
        for z, found in reach.items():
            piece = found[at[:n] + t]
            some = np.flatnonzero(piece != none)
            if 2 * len(some) > n:
                now += sums[back + t - z, :n] * table[piece]
            elif len(some):
                now[some] += sums[back + t - z, some] * table[piece[some]]
        if t % 8 == 7:
            last = sums[t + 1 : back + t + 1, :n]
            scale = last.max(axis=0)
            scale[scale == 0] = 1
            last /= scale
            total[:n] += np.log(scale)
    out = np.zeros((len(lane), back, table.shape[1]))
    out[order] = _log(sums[(back - 1 + size)[:, None] - np.arange(back), np.arange(len(lane))[:, None]]) + total[:, None]
    return out


def forward(pieces: Pieces, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the summed probability of all segmentations, for each word and language."""
    table, out = _padded(probabilities), np.zeros((len(words), probabilities.shape[1]))
    for n, own in _by_length(words).items():
        for lo in range(0, len(own) if n <= PLAIN else 0, TOGETHER):
            part = own[lo : lo + TOGETHER]
            out[part] = np.log(_ahead(_edges(pieces, [words[i] for i in part]), n, table, len(part))[n])
    long = [i for i, w in enumerate(words) if len(w) > PLAIN]
    if long:
        out[long] = _long(pieces, table, [words[i] for i in long])
    return out


def expected(pieces: Pieces, probabilities: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected count of each piece in each language; weights: how often each word stands in each language."""
    table = _padded(probabilities)
    logs, total = _log(table), np.zeros_like(table)
    for n, own in _by_length(words).items():
        step = max(1, TOGETHER * PLAIN // max(n, PLAIN))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            edges = _edges(pieces, [words[i] for i in part])
            if n <= PLAIN:
                alpha = _ahead(edges, n, table, len(part))
                beta = np.zeros_like(alpha)
                beta[n] = 1
                for start, end, found in reversed(edges):
                    beta[start] += beta[end] * table[found]
                scale = weights[part] / alpha[n]
                for start, end, found in edges:
                    np.add.at(total, found, alpha[start] * table[found] * beta[end] * scale)
            else:
                alpha = _ahead_logs(edges, n, logs, len(part))
                beta = np.full_like(alpha, -np.inf)
                beta[n] = 0
                for start, end, found in reversed(edges):
                    np.logaddexp(beta[start], beta[end] + logs[found], out=beta[start])
                for start, end, found in edges:
                    np.add.at(total, found, np.exp(alpha[start] + logs[found] + beta[end] - alpha[n]) * weights[part])
    return total[: pieces.size]


def runs(text: str) -> list[str]:
    """Marked words of letters, lower-cased."""
    found = (run if run.isalpha() else "".join(c for c in run if c.isalpha()) for run in _RUN.findall(text.lower()))
    return ["▁" + run for run in found if run]


def _count(batches):
    """(lang, word, n) of each batch; long words in parts."""
    for batch in passes(batches, 1):
        counts: dict = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in runs(text):
                for part in (word[i : i + LEARNED] for i in range(0, len(word), LEARNED)):
                    counts[lang, part] = counts.get((lang, part), 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def _expect(names: list[str], langs: list[str], probabilities: np.ndarray):
    def run(batches):
        pieces, at = Pieces(names), {x: i for i, x in enumerate(langs)}
        total = np.zeros_like(probabilities)
        for batch in passes(batches, 1):
            words = batch.column(1).to_pylist()
            weights = np.zeros((len(words), len(langs)))
            weights[np.arange(len(words)), [at[x] for x in batch.column(0).to_pylist()]] = batch.column(2).to_numpy()
            total += expected(pieces, probabilities, words, weights)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(total[where])], ["piece", "lang", "n"])

    return run


class Model:
    def __init__(self, names: list[str], langs: list[str], probabilities: np.ndarray):
        self.names, self.langs, self.probabilities = names, langs, probabilities

    def fresh(self) -> Model:
        """A copy with an empty memory of words."""
        out = Model(self.names, self.langs, self.probabilities)
        out.pieces = Pieces(self.names)
        out.keys, out.rows = np.zeros(0, U64), np.zeros((0, self.probabilities.shape[1] + 1))
        return out

    def words(self, keys: np.ndarray, texts) -> np.ndarray:
        """Per word its log probability in each language and its number of letters; texts(i) gives word i."""
        if len(self.keys) > REMEMBERED:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(np.append(self.keys, U64(0))[where] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            parts = [runs(texts(i)) for i in first[new]]
            flat = sorted({p for ps in parts for p in ps})
            number = {p: i for i, p in enumerate(flat)}
            score = forward(self.pieces, self.probabilities, flat)
            rows = np.zeros((len(new), self.rows.shape[1]))
            owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
            picked = [number[p] for ps in parts for p in ps]
            if picked:
                np.add.at(rows[:, :-1], owner, score[picked])
                np.add.at(rows[:, -1], owner, [len(flat[i]) - 1 for i in picked])
            self.keys, self.rows = np.insert(self.keys, where[new], unique[new]), np.insert(self.rows, where[new], rows, axis=0)
            where = np.searchsorted(self.keys, unique)
        return self.rows[where][back]


def fit(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Piece probabilities of each language from at most about sample_rows rows of it."""
    names = vocabulary(vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    # A row per language: far less than the model, which has the whole vocabulary for each.
    sample = rows.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.col("size")) < sample_rows).select("lang", "text")
    counts = Scratch(labelled.sparkSession).cut(sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    probabilities = np.full((len(names), max(1, len(langs))), 1 / len(names))
    for _ in range(ITERATIONS if langs else 0):
        gained = counts.mapInArrow(_expect(names, langs, probabilities), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(probabilities)
        total[gained.piece.to_numpy(), gained.lang.to_numpy()] = gained.n.to_numpy()
        total += SMOOTH
        probabilities = total / total.sum(axis=0)
    return Model(names, langs, probabilities)


def _guess(model: Model, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(language, score) of each text."""
    data, offsets = text_buffer(column)
    keys, first, begin, end = word_hashes(data, offsets, places=True)
    raw = data.tobytes()
    scores = model.words(keys, lambda i: raw[begin[i] : end[i]].decode())
    sums, full = np.zeros((len(column), scores.shape[1])), first[1:] > first[:-1]
    if full.any():
        sums[full] = np.add.reduceat(scores, first[:-1][full], axis=0)
    log, letters = sums[:, :-1], np.round(sums[:, -1])
    best = log.argmax(axis=1)
    score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
    und = (letters == 0) | (not model.langs)
    names = np.array([*model.langs, "und"], object)
    return pa.array(names[np.where(und, len(names) - 1, best)], pa.string()), pa.array(np.where(und, 0.0, score))


def _predict(shared):
    def run(batches):
        model = worker_state(("language", shared.id), lambda: shared.value.fresh())
        for batch in passes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_guess(model, batch.column("text"))], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (probability among the learned languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages numbers
    return whole(docs, id_col, text_col).mapInArrow(_predict(_Shared(shared)), "doc_id long, lang_pred string, score double")


def _keep(shared, lang_col: str, text_col: str):
    def run(batches):
        model = worker_state(("language", shared.id), lambda: shared.value.fresh())
        for batch in passes(batches, text_col):
            lang, _ = _guess(model, batch.column(text_col))
            known = pa.array([x != "und" for x in lang.to_pylist()], pa.bool_())
            yield batch.set_column(batch.schema.get_field_index(lang_col), lang_col, lang).filter(known)

    return run


def keep_identified(docs: DataFrame, model: Model, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows of docs whose text has a language, which becomes their column lang_col."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages numbers
    return docs.mapInArrow(_keep(_Shared(shared), lang_col, text_col), docs.schema)


class _Shared:
    """A broadcast model with a number by which a worker knows that it has it already."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2

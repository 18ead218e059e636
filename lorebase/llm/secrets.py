"""Secret scans by one combined deterministic automaton.

The rules' expressions become one nondeterministic automaton over bytes; subset construction and minimisation turn
it into a transition array, in which every state knows the rules that have just matched. All rules are scanned
in one pass over the bytes, which gives the ends of all matches. A batch is cut after bytes that send every state
back to the start, and its pieces take their steps together; the last of them, such as a long run of one class
of bytes, go on alone in plain lists. Each rule also has an automaton of its reversed
expression, and of the stricter one that its matches must meet; read backwards from an end, it gives the starts.
Of the matches of a rule the leftmost is taken, the longest of one start, then the next one after its end; those
that do not meet the stricter expression are dropped. Expressions are read by Python's own parser; no span
comes from its matcher.

Spans are in code points, the end exclusive. Defined results: a null or empty text has no span. Very
long texts are scanned whole. Repeated rows agree. Extra columns are ignored or, in redact, kept.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import passes, text_buffer, whole

_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
#: (kind, expression, stricter expression that a match must meet whole). Each ends in a run of one class of bytes, or in fixed bytes.
RULES = [
    ("assign", _KEY + "[A-Za-z0-9+/_.=-]+", _KEY + "[A-Za-z0-9+/_.=-]{6,}"),
    ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24,}", "[0-9a-f]{24,}"),
    ("forge", "gh[pousr]_[A-Za-z0-9]{20,}", "gh[pousr]_[A-Za-z0-9]{20,}"),
    ("chat", "xox[abprs]-[A-Za-z0-9]{10,}", "xox[abprs]-[A-Za-z0-9]{10,}"),
    ("pem", _PEM, _PEM),
]
KINDS = [r[0] for r in RULES]
BASE = 3
#: Bytes whose pieces take their steps together.
SCAN_BYTES = 1 << 22
#: With no more pieces than these, each takes its further steps by itself, in plain lists.
FEW = 64


class Machine:
    """A nondeterministic automaton over bytes: steps[state] = {bytes: states}, skips[state] = states."""

    def __init__(self):
        self.steps: list[dict[frozenset, set]] = []
        self.skips: list[set] = []

    def state(self) -> int:
        self.steps.append({})
        self.skips.append(set())
        return len(self.steps) - 1

    def follow(self, at: int, parsed, any_case: bool = False) -> int:
        """Add a parsed expression after state at; returns its last state."""
        for op, value in parsed:
            name = str(op)
            if name in ("LITERAL", "IN"):
                chars = [value] if name == "LITERAL" else [c for kind, v in value for c in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))]
                if any_case:
                    chars = {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())}
                to = self.state()
                self.steps[at].setdefault(frozenset(chars), set()).add(to)
                at = to
            elif name == "SUBPATTERN":
                at = self.follow(at, value[3], any_case or bool(value[1] & re.IGNORECASE))
            elif name == "BRANCH":
                end = self.state()
                for option in value[1]:
                    self.skips[self.follow(at, option, any_case)].add(end)
                at = end
            elif name == "MAX_REPEAT":
                least, most, part = value
                for _ in range(least):
                    at = self.follow(at, part, any_case)
                if str(most) == "MAXREPEAT":
                    loop = self.state()
                    self.skips[at].add(loop)
                    self.skips[self.follow(loop, part, any_case)].add(loop)
                    at = loop
                for _ in range(0 if str(most) == "MAXREPEAT" else most - least):
                    to = self.follow(at, part, any_case)
                    self.skips[at].add(to)
                    at = to
            else:
                raise ValueError(f"no such part of an expression here: {name}")
        return at

    def reversed(self) -> Machine:
        out = Machine()
        for _ in self.steps:
            out.state()
        for s, moves in enumerate(self.steps):
            for chars, ends in moves.items():
                for t in ends:
                    out.steps[t].setdefault(chars, set()).add(s)
            for t in self.skips[s]:
                out.skips[t].add(s)
        return out


class Automaton:
    """Deterministic and minimal. classes: class of each byte; table[state + class]: next state; hits[state]: bits of finals.

    States are multiples of n, the number of classes; the start is 0. always: the start is entered again at every byte.
    """

    def __init__(self, machine: Machine, starts: set[int], finals: dict[int, int], always: bool):
        sets = {c for s in machine.steps for c in s}
        signature = [tuple(b in c for c in sets) for b in range(256)]
        numbers = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([numbers[s] for s in signature], np.uint8)
        self.n = len(numbers)
        one = [int(np.flatnonzero(self.classes == c)[0]) for c in range(self.n)]
        moves = [[frozenset(t for c, ts in s.items() if b in c for t in ts) for b in one] for s in machine.steps]
        again = starts if always else set()

        def closed(states) -> frozenset:
            out, todo = set(states), list(states)
            while todo:
                for t in machine.skips[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(out)

        first = closed(starts)
        known, order, rows, seen = {first: 0}, [first], [], {}
        while len(rows) < len(order):
            row, own = [], [moves[s] for s in order[len(rows)]]
            for c in range(self.n):
                reached = frozenset(again).union(*[m[c] for m in own])
                if reached not in seen:
                    target = closed(reached)
                    if target not in known:
                        known[target] = len(order)
                        order.append(target)
                    seen[reached] = known[target]
                row.append(seen[reached])
            rows.append(row)
        hits = [0] * len(order)
        dead = known.get(frozenset())
        for i, states in enumerate(order):
            for s in states:
                hits[i] |= finals.get(s, 0)
        self._minimise(np.array(rows), np.array(hits))
        self.dead = -1 if dead is None else int(self.block[dead]) * self.n

    def _minimise(self, rows: np.ndarray, hits: np.ndarray) -> None:
        """Merge states that no input tells apart, by refining classes of equal hits."""
        block, count = np.unique(hits, return_inverse=True)[1], 0
        while block.max() + 1 != count:
            count = block.max() + 1
            block = np.unique(np.column_stack((block, block[rows])), axis=0, return_inverse=True)[1].ravel()
        names = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}
        self.block = np.array([names[b] for b in block.tolist()])
        first = np.array([int(np.flatnonzero(self.block == b)[0]) for b in range(len(names))])
        self.table = self.block[rows[first]].astype(np.int32).ravel() * self.n
        self.hits = np.repeat(hits[first].astype(np.uint16), self.n)
        self.resets = (self.table.reshape(-1, self.n) == 0).all(axis=0)[self.classes]

    def ends(self, data: np.ndarray, offsets: np.ndarray, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(places of the last bytes of matches, bits of their rules), ascending, all documents of data scanned in one pass.

        A match that a longer one of the same start and rules follows byte by byte may be left out.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        after = np.flatnonzero(self.resets[data]) + 1
        cuts = after[np.minimum(np.searchsorted(after, np.arange(piece, len(data), piece)), len(after) - 1)] if len(after) else after
        begin = np.unique(np.concatenate((offsets[:-1], cuts)))
        begin = begin[begin < len(data)]
        size = np.diff(begin, append=len(data))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        inputs = self.classes[data]
        state = np.zeros(len(begin), np.int32)
        longer = len(begin) - np.searchsorted(size[::-1], np.arange(int(size[0])), "right")  # pieces with a byte i
        places, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for i, n in enumerate(longer.tolist()):
            if n <= FEW:
                for lane in range(n):
                    self._alone(inputs[begin[lane] + i : begin[lane] + size[lane]].tobytes(), int(state[lane]), int(begin[lane]) + i, places, bits)
                break
            now = self.table[state[:n] + inputs[begin[:n] + i]]
            state[:n] = now
            hit = self.hits[now]
            if hit.any():
                which = np.flatnonzero(hit)
                places.append(begin[which] + i)
                bits.append(hit[which])
        places, bits = np.concatenate(places), np.concatenate(bits)
        order = np.argsort(places)
        return places[order], bits[order]

    @functools.cached_property
    def lists(self) -> tuple[list, list, list]:
        """classes, table and hits as plain lists, which are faster one step at a time."""
        return self.classes.tolist(), self.table.tolist(), self.hits.tolist()

    def _alone(self, inputs: bytes, state: int, at: int, places: list, bits: list) -> None:
        """Add the ends in one piece, whose bytes' classes are inputs from place at on; of neighbouring ends of the same rules the last."""
        _, table, hits = self.lists
        where, which, before = [], [], 0
        for i, c in enumerate(inputs, at):
            state = table[state + c]
            now = hits[state]
            if now != before:
                if before:
                    where.append(i - 1)
                    which.append(before)
                before = now
        if before:
            where.append(at + len(inputs) - 1)
            which.append(before)
        places.append(np.array(where, np.int64))
        bits.append(np.array(which, np.uint16))


class Scanner:
    """All rules: the combined automaton, and for each rule the one that finds starts from an end."""

    def __init__(self, rules=RULES):
        from re import _parser as parser

        every, finals = Machine(), {}
        start = every.state()
        self.back = []
        for k, (_, loose, strict) in enumerate(rules):
            end = every.follow(start, parser.parse(loose))
            finals[end] = finals.get(end, 0) | 1 << k
            own = Machine()
            both = [(a := own.state(), own.follow(a, parser.parse(x))) for x in (loose, strict)]
            found = {a: 1 << i for i, (a, _) in enumerate(both)}
            self.back.append(Automaton(own.reversed(), {end for _, end in both}, found, always=False))
        self.all = Automaton(every, {start}, finals, always=True)

    def leftmost(self, k: int, raw: bytes, lo: int, last: int) -> tuple[int, bool] | None:
        """(start, whether it meets the stricter expression) of the leftmost match of rule k from lo on that ends with byte last."""
        classes, table, hits = self.back[k].lists
        state, dead, start, bits = 0, self.back[k].dead, -1, 0
        for i in range(last, lo - 1, -1):
            state = table[state + classes[raw[i]]]
            if state == dead:
                break
            if hits[state]:
                start, bits = i, hits[state]
        return None if start < 0 else (start, bits > 1)

    def chosen(self, k: int, raw: bytes, lo: int, ends: list[int]) -> list[tuple[int, int]]:
        """(start, end) of the matches of rule k in a document that begins at lo, from their last bytes.

        Each end waits with its leftmost start alone, and looks again behind a match that has taken that start.
        """
        found = [(s[0], -e, s[1]) for e in ends if (s := self.leftmost(k, raw, lo, e))]
        heapq.heapify(found)
        out, free = [], lo
        while found:
            s, e, good = heapq.heappop(found)
            if s >= free:
                free = 1 - e
                if good:
                    out.append((s, free))
            elif -e >= free and (again := self.leftmost(k, raw, free, -e)):
                heapq.heappush(found, (again[0], e, again[1]))
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray, piece: int = 512) -> list[list[tuple[int, int, int]]]:
        """For each document (start, number of kind, end) in code points of all matches, in that order."""
        places, bits = self.all.ends(data, offsets, piece)
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        if not len(places):
            return out
        owner = np.searchsorted(offsets, places, "right") - 1
        raw = data.tobytes()
        for k in range(len(self.back)):
            own = np.flatnonzero(bits >> k & 1)
            if not len(own):
                continue
            at, doc = places[own], owner[own]
            last = np.append((at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]), True)  # a longer match of the same start goes on
            ends: dict[int, list[int]] = {}
            for e, d in zip(at[last].tolist(), doc[last].tolist(), strict=True):
                ends.setdefault(d, []).append(e)
            for d, own in ends.items():
                out[d].extend((s, k, e) for s, e in self.chosen(k, raw, int(offsets[d]), own))
        for d in np.unique(owner).tolist():
            if out[d]:
                lo = int(offsets[d])
                code_point = np.concatenate(([0], np.cumsum((data[lo : int(offsets[d + 1])] & 0xC0) != 0x80)))
                out[d] = sorted((int(code_point[s - lo]), k, int(code_point[e - lo])) for s, k, e in out[d])
        return out


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _batches(batches, shared, column: str):
    for batch in passes(batches, column, SCAN_BYTES):
        yield batch, shared.value.spans(*text_buffer(batch.column(column)))


def _find(shared):
    def run(batches):
        for batch, found in _batches(batches, shared, "text"):
            base = [[s for s in f if s[1] < BASE] for f in found]
            counts = [pa.array([sum(s[1] == k for s in f) for f in base], pa.int64()) for k in range(BASE)]
            sha = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(f) for f in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def _redact(shared, mark: str, text_col: str):
    def run(batches):
        for batch, found in _batches(batches, shared, text_col):
            texts = batch.column(text_col).to_pylist()
            for i, f in enumerate(found):
                if f:
                    out, at = [], 0
                    for a, _, b in f:
                        if b > at:
                            out += [texts[i][at:a], mark] if a >= at else []
                            at = b
                    texts[i] = "".join(out) + texts[i][at:]
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner())  # the rules' size alone
    return whole(docs, id_col, text_col).mapInArrow(_find(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span of its text column replaced by mark; a null text becomes empty."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner())
    return docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))).mapInArrow(_redact(shared, mark, text_col), docs.schema)

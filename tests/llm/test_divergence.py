"""The audit against brute force, with runs spilled all the time and merged in rounds."""

import random
import re
from collections import Counter

import pytest

from lorebase.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, number long, run int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "x", 1, 0) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def brute(rows, least=3, top=200):
    words = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in words}:
        seen, total, own = Counter(), Counter(), {}
        for w, l, s in words:
            if l == lang:
                seen.update(set(w))
                total.update(w)
                own.setdefault(s, Counter()).update(w)
        kept = [t for t in seen if seen[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        q, p = share(total), {s: share(c) for s, c in own.items()}
        for s in own:
            told = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])
            far = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s)
            for part, items in (("term", told[:top]), ("pair", far)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def rows_of(n, rng, vocabulary):
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "a", "b", "ü", None])) for _ in range(n)]
    rows += [rows[0]] * 5 + [(None, "en", "empty"), ("", "xx", "one"), ("1 2 3 @", "xx", "two"), ("Straße STRASSE strasse_Straße", "en", "a"), ("x" * 100_000 + " " + "y " * 100_000, "fr", "long")]
    return rows


@pytest.mark.parametrize(("block", "fan_in"), [(400_000, 256), (40, 4)])
def test_equals_brute_force(spark, block, fan_in):
    rng = random.Random(block)
    vocabulary = ["".join(rng.choice("abcÉéÀß日") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = rows_of(120, rng, vocabulary)
    got = divergence.audit(docs(spark, rows), block=block, fan_in=fan_in).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(rows)


@pytest.mark.parametrize("dense", [1 << 21, 10])
def test_many_sources_and_sides(spark, monkeypatch, dense):
    monkeypatch.setattr(divergence, "SIDE", 3)
    monkeypatch.setattr(divergence, "PAIRS", 20)
    monkeypatch.setattr(divergence, "DENSE", dense)
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randint(1, 9))), "en", f"s{i % 11}") for i in range(60)]
    got = divergence.audit(docs(spark, rows), top=2).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(rows, top=2)


def test_empty_table_and_rare_words(spark):
    assert divergence.audit(docs(spark, [])).collect() == []
    got = divergence.audit(docs(spark, [("a b", "en", "x"), ("c", "en", "y")])).collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in got) == [("x", "pair", "y", 0, 1), ("y", "pair", "x", 0, 1)]


def test_merge_opens_segments_only_when_reached():
    entries = [(b"a", 1, {"s": 1}), (b"c", 2, {"s": 5}), (b"d", 1, {"t": 1})]
    other = [(b"b", 1, {"t": 2}), (b"c", 1, {"t": 7, "s": 1})]
    segments = [row[3:] for row in sorted([*divergence._segments(0, 1, "en", entries), *divergence._segments(0, 2, "en", other)], key=lambda r: r[2:4])]
    assert list(divergence._merged(iter(segments))) == [(b"a", 1, {"s": 1}), (b"b", 1, {"t": 2}), (b"c", 3, {"s": 6, "t": 7}), (b"d", 1, {"t": 1})]

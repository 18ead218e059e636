"""The operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.llm import language, minhash, neighbours, packing, secrets, sentencepieces, sharding, suffixes, syncmers, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hashes string, rep long, tile int"


def docs(spark, texts):
    """A table whose extra columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 0, 1) for i, t in texts], SCHEMA)


AWKWARD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "é, ß. two  words\n"), (6, "日本語 😀 text"), (7, "a " * 3000), (8, "x" * 5000), (9, "one two three four five six seven eight nine ten")]
OPERATORS = {
    "minhash": lambda d: minhash.near_duplicates(d),
    "secrets": lambda d: secrets.find_secrets(d),
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "sharding": lambda d: sharding.shard(d, 4, cells=8),
    "syncmers": lambda d: syncmers.fingerprints(d),
    "packing": lambda d: packing.pack(d),
    "pieces": lambda d: sentencepieces.digest(d),
    "language": lambda d: language.identify(d, language.fit(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_and_empty_table(spark, name):
    out = OPERATORS[name](docs(spark, AWKWARD))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in AWKWARD}
    assert OPERATORS[name](docs(spark, [])).count() == 0


def words(n, rng, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [words(rng.randint(1, 120), rng, vocabulary) for _ in range(60)]
    for _ in range(90):  # chains of near copies
        base = rng.choice(texts).split(" ")
        base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [texts[3]] * 5 + [texts[4].upper()] + ["Same five words right here", "same  five words\nright here"]
    return list(enumerate(texts)) + [(900, None), (901, ""), (902, "  ")]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(spark, copies):
    sets = {i: shingles(t) for i, t in copies}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs(spark, copies)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def test_bucket_chunks_lose_nothing(spark, copies, monkeypatch):
    want = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs(spark, copies)).collect()}
    monkeypatch.setattr(minhash, "CHUNK", 3)
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "MEMBERS", 2)  # families above it are confirmed in tiles
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs(spark, copies)).collect()} == want


def removed(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("many", [512, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    rng = random.Random(11)
    passage = "".join(rng.choice("abé ") for _ in range(90))
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 80))) + passage[: rng.randint(30, 90)] + str(i) * rng.randint(0, 9)) for i in range(40)]
    rows += [(50, "z" * 300), (51, "xy" * 150), (52, rows[0][1]), (53, None), (54, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs(spark, rows), length=48).collect()}
    assert got == removed(rows, 48)


def test_suffix_sort_equals_sorting():
    rng = random.Random(1)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(20, 90))) * rng.randint(1, 2) for _ in range(rng.randint(1, 6))]
        counts = [len(p) - 19 for p in parts]
        seen = Counter(p[i : i + 20] for p, n in zip(parts, counts, strict=True) for i in range(n))
        want = [[i for i in range(n) if seen[p[i : i + 20]] > 1] for p, n in zip(parts, counts, strict=True)]
        assert [x.tolist() for x in suffixes.repeated(parts, counts, 20)] == want


SECRET_TEXTS = [
    "token = abcdef123, PassWord: 'hunter22' secret:x",
    "AKIA" + "B2" * 10 + " AKIAshort " + "0af" * 9,
    "api_key=\"" + "k" * 8 + "\" apikey : abc token=token=abcdefg",
    "é token='ünot' deadbeef" * 3,
    "ghp_" + "a1" * 12 + " xoxb-" + "z" * 12 + "\n-----BEGIN RSA PRIVATE KEY-----",
    "no secret here",
    None,
    "",
]


def test_secret_spans_equal_expressions(spark):
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, list(enumerate(SECRET_TEXTS)))).collect()}
    for i, text in enumerate(SECRET_TEXTS):
        base = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(base) for m in re.finditer(p, text or "") if len(m[g]) >= n)
        joined = ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    redacted = {r.doc_id: r.text for r in secrets.redact(docs(spark, list(enumerate(SECRET_TEXTS)))).collect()}
    assert redacted[5] == "no secret here" and "hunter22" not in redacted[0] and "[SECRET]" in redacted[4]


def by_expressions(text, rules=secrets.RULES):
    return sorted((m.start(), k, m.end()) for k, (_, loose, strict) in enumerate(rules) for m in re.finditer(loose, text, re.ASCII) if re.fullmatch(strict, m[0], re.ASCII))


@pytest.mark.parametrize("piece", [8, 512])
def test_automaton_spans_equal_expressions(piece):
    rng = random.Random(4)
    parts = ["token", "=", '"', " ", "AKIA", "ABCD1234", "deadbeef0123", "x", "api_key", ":", "Passwd", "é", "\n", "ghp_", "a1b2c3", "secret", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----END ", "xoxb-", ",", "abc", "A" * 9, "0f" * 12]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["-----BEGIN RSA PRIVATE KEY-----\nMIIEow==\nabc\n-----END RSA PRIVATE KEY-----\nrest", "-----BEGIN PRIVATE KEY-----\nMIIEow\n!", "token=" + "token=" * 500 + "x", "token=token: token=abcdef", "a" * 30 + "Z" + "f" * 24]
    got = secrets.scanner().spans(*secrets.text_buffer(pa.array(texts)), piece=piece)
    assert sum(map(len, got)) > 500 and {k for f in got for _, k, _ in f} == set(range(len(secrets.RULES)))
    for text, found in zip(texts, got, strict=True):
        assert found == by_expressions(text), text


@pytest.mark.parametrize("few", [0, 64, 10**9])
def test_spans_of_long_runs(monkeypatch, few):
    monkeypatch.setattr(secrets, "FEW", few)
    rng = random.Random(6)
    runs = ["".join(rng.choice(letters) for _ in range(3000)) for letters in ("0123456789abcdef", "ABCDEFGH01234567", "ABCabc012+/=")]
    texts = [runs[0], "AKIA" + runs[1], "AKIA" * 500, "token=" + runs[2] + "=" + runs[0], "secret=token=" * 200, "é" + runs[0] + "x" + runs[0], "-----BEGIN PRIVATE KEY-----" + runs[2] + "-----END PRIVATE KEY-----" + runs[2]]
    got = secrets.scanner().spans(*secrets.text_buffer(pa.array(texts)))
    assert got == [by_expressions(t) for t in texts] and all(got)


def test_a_megabyte_of_one_run_is_fast_and_small():
    for unit in ("0123456789abcdef", "AKIA", "token=", "Zz9+"):
        data, offsets = secrets.text_buffer(pa.array([unit * (2**20 // len(unit))]))
        secrets.scanner().spans(data[:600], np.array([0, 600]))
        tracemalloc.start()
        began = time.process_time()
        found = secrets.scanner().spans(data, offsets)[0]
        used = time.process_time() - began
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert used < 10 and peak < 120e6  # with the tracing, which slows it several times
        assert len(found) == (unit != "Zz9+")


def test_spans_come_from_the_automaton():
    column = secrets.text_buffer(pa.array([t or "" for t in SECRET_TEXTS]))
    found = {k for f in secrets.scanner().spans(*column) for _, k, _ in f}
    for left_out in found:
        rules = [("none", "\x01{9}", "\x01{9}") if k == left_out else r for k, r in enumerate(secrets.RULES)]
        assert {k for f in secrets.Scanner(rules).spans(*column) for _, k, _ in f} == found - {left_out}


def test_packing_equals_encoding_whole_texts(spark):
    hard = ["a  b", "a \nb", "<|endoftext|> x<|endoftext|>\ny", "it's,'s don't.,. 5.5, x  y", "a,\n\nb. c", "\n \n x", "é,. ß.  é\n x", "x .y. ..", "word " * 900]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(hard)]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces = packing.pack(docs(spark, rows).repartition(3)).collect()
    at = Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in want.items()}
    filled = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    place = 0
    for s, o, n in filled:
        assert s * 1024 + o == place
        place += n


def test_pieces_round_trip_and_best_score():
    import public_tokenizers

    model = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    scores = {n.encode().replace("▁".encode(), b"\xff"): s for n, s in zip(model.names, model.scores.tolist(), strict=True) if s != sentencepieces.BYTE_SCORE}

    def best(w):
        out = [0.0] + [None] * len(w)
        for j in range(1, len(w) + 1):
            out[j] = max([out[j - 1] + sentencepieces.BYTE_SCORE] + [out[i] + scores[w[i:j]] for i in range(max(0, j - 50), j) if w[i:j] in scores])
        return out[-1]

    rng = random.Random(8)
    words = [b"\xff" + w.encode() for w in ["the", "unbelievable", "日本語😀", "\t\x00", "Straße", "a▁b", "", "ab" * 300]] + [b"\xff\xff"]
    words += [b"\xff" + "".join(rng.choice("aeinrstß語") for _ in range(rng.randint(1, 14))).encode() for _ in range(300)]
    ids, count = model.solve(words)
    for w, own in zip(words, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert sum(model.scores[own.astype(int)]) == pytest.approx(best(w))
    texts = [t for _, t in AWKWARD if t] + ["  two  spaces ", "\n", "a ▁ mark▁▁ x", "▁"]
    encoder = sentencepieces.Encoder(model)
    for batch in (texts, ["", *texts, ""]):
        data, offsets = sentencepieces.text_buffer(pa.array(batch))
        for _ in range(2):  # the second time from memory
            ids, bounds = encoder(data, offsets)
            back, ends = model.decode(ids, bounds)
            assert [back[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == batch


def test_long_words_have_the_same_pieces(monkeypatch):
    import public_tokenizers

    model = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    words = [b"\xff" + "".join(rng.choice("aeinrst語-=A9+/") for _ in range(rng.randint(20, 120))).encode() for _ in range(60)]
    words += [b"\xff" + b"a" * 300, b"\xff" * 70, b"\xff" * 70, b"\xff" + "深度学习模型".encode() * 20, b"\xff" + bytes(range(128, 255)), b"\xffthe"]
    monkeypatch.setattr(sentencepieces, "SHORT", 10**9)
    want = model.solve(words)
    for places in (1, 7, 1 << 16):
        monkeypatch.setattr(sentencepieces, "SHORT", 0)
        monkeypatch.setattr(sentencepieces, "PLACES", places)
        monkeypatch.setattr(sentencepieces, "TOGETHER", 100 * places)
        got = model.solve(words)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_a_megabyte_without_spaces_is_encoded_fast():
    import public_tokenizers

    model, rng = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model")), random.Random(7)
    for letters, n in (("a", 2**18), ("".join(map(chr, range(65, 123))), 2**18), ("語学習深度模型", 2**17)):
        data, offsets = sentencepieces.text_buffer(pa.array(["".join(rng.choice(letters) for _ in range(n)), "", letters]))
        encoder, began = sentencepieces.Encoder(model), time.process_time()
        ids, bounds = encoder(data, offsets)
        assert time.process_time() - began < 4  # single steps of arrays took 25 to 100
        back, ends = model.decode(ids, bounds)
        assert back.tobytes() == data.tobytes() and np.array_equal(ends, offsets)


def test_pieces_table_round_trip(spark):
    rows = [*AWKWARD, (20, "a ▁ mark▁▁")]
    back = {r.doc_id: r.text for r in sentencepieces.decode(sentencepieces.encode(docs(spark, rows))).collect()}
    assert back == {i: t or "" for i, t in rows}


@pytest.mark.parametrize("nodes", [2048, 3])
def test_shards(spark, monkeypatch, nodes):
    monkeypatch.setattr(sharding, "NODES", nodes)
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 200) if i % 7 else "same text") for i in range(500)] + [(1000, None), (1001, "")]
    got = sharding.shard(docs(spark, rows), 5, cells=7).collect()
    assert len(got) == len(rows)
    sizes, slots, texts = Counter(), {}, {}
    by = dict(rows)
    for r in got:
        text = by[r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert texts.setdefault(text, r.shard) == r.shard  # equal texts stay together
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 200


def plain_differencing(sums):
    """Lists of partial partitions; the two of largest spread are combined, largest part with smallest."""
    nodes = [(sorted(((int(x), [(i, j)]) for j, x in enumerate(row)), key=lambda p: -p[0]), i) for i, row in enumerate(sums)]
    new = len(nodes)
    while len(nodes) > 1:
        nodes.sort(key=lambda n: (-(n[0][0][0] - n[0][-1][0]), n[1]))
        (a, _), (b, _) = nodes.pop(0), nodes.pop(0)
        nodes.append((sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)), key=lambda p: -p[0]), new))
        new += 1
    return [x for x, _ in nodes[0][0]]


def test_differencing_equals_plain_form():
    rng = np.random.default_rng(4)
    for k in (2, 3, 7):
        sums = np.zeros((60, k), np.int64)
        sums[:, 0] = rng.permutation(np.arange(1000, 100_000, 997))[:60]
        parts = sharding.difference(sums)
        assert sorted(np.bincount(parts[:, 0], sums[:, 0], k).astype(int)) == sorted(plain_differencing(sums))


def test_differencing_is_tight():
    rng = np.random.default_rng(0)
    sums = np.zeros((400, 8), np.int64)
    sums[:, 0] = rng.integers(1, 10_000, 400)
    parts = sharding.difference(sums)
    assert all(sorted(p) == list(range(8)) for p in parts.tolist())
    totals = np.bincount(parts[:, 0], sums[:, 0], 8)
    assert totals.max() - totals.min() < 100


@pytest.mark.parametrize("n_hashes", [1, 2, 3])
def test_neighbours_recall_and_awkward_vectors(spark, monkeypatch, n_hashes):
    monkeypatch.setattr(neighbours, "hashes", lambda n, axes: n_hashes)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "HELD", 50)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 24)))]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] + [1.0] * 23), (504, [None] + [1.0] * 23), (505, rows[3][1]), (506, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash"))
    got = neighbours.search(df, F.col("vec_id") % 10 == 0).collect()
    good = {i: np.array(v) for i, v in rows if i < 500 or i > 504}
    hit = total = 0
    for q in range(0, 400, 10):
        own = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(abs(r.score - float(np.sqrt(((good[q] - good[r.vec_id]) ** 2).sum()))) < 1e-12 for r in mine)
        hit += len({r.vec_id for r in mine} & {i for _, i in own})
        total += 10
    assert hit / total >= 0.9
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_language_held_out(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "ver"]}
    rows = []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(12)), lang))
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", "bb")], "doc_id long, text string, lang string")
    model = language.fit(df.filter(~language.held_out()))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_forward_sums_all_segmentations():
    names = ["a", "ab", "abc", "b", "bc", "c", "▁", "▁a"]
    p = np.random.default_rng(0).dirichlet(np.ones(len(names)), 2).T

    def brute(word, lang):
        if not word:
            return 1.0
        return sum(p[i, lang] * brute(word[len(n) :], lang) for i, n in enumerate(names) if word.startswith(n))

    got = language.forward(language.Pieces(names), p, ["▁abc", "▁a"])
    assert np.allclose(np.exp(got), [[brute(w, lang) for lang in (0, 1)] for w in ("▁abc", "▁a")])


def segmentations(word, names):
    if not word:
        yield []
    for i, n in enumerate(names):
        if word.startswith(n):
            for rest in segmentations(word[len(n) :], names):
                yield [i, *rest]


@pytest.mark.parametrize("plain", [32, 0])
def test_expected_counts_over_all_segmentations(monkeypatch, plain):
    monkeypatch.setattr(language, "PLAIN", plain)  # with 0 all sums are taken in logarithms
    names = ["a", "ab", "abc", "b", "bc", "c", "▁", "▁a"]
    p = np.random.default_rng(0).dirichlet(np.ones(len(names)), 2).T
    words, weights = ["▁abc", "▁a", "▁abcab"], np.array([[2.0, 1.0], [0.0, 3.0], [1.0, 1.0]])
    want = np.zeros_like(p)
    for w, word in enumerate(words):
        for lang in (0, 1):
            all_ = [(s, np.prod([p[i, lang] for i in s])) for s in segmentations(word, names)]
            for s, x in all_:
                for i in s:
                    want[i, lang] += weights[w, lang] * x / sum(y for _, y in all_)
    assert np.allclose(language.expected(language.Pieces(names), p, words, weights), want)
    got = language.forward(language.Pieces(names), p, words)
    assert np.allclose(np.exp(got), [[sum(np.prod([p[i, lang] for i in s]) for s in segmentations(w, names)) for lang in (0, 1)] for w in words])


def test_long_words_do_not_underflow(spark, monkeypatch):
    names = ["a", "ab", "abc", "b", "bc", "c", "▁", "▁a"]
    p = np.random.default_rng(1).dirichlet(np.ones(len(names)), 2).T
    pieces, word = language.Pieces(names), "▁" + "abcab?" * 30
    logs = language._ahead_logs(language._edges(pieces, [word]), len(word), language._log(language._padded(p)), 1)[-1][0]
    assert np.allclose(language.forward(pieces, p, [word])[0], logs) and np.isfinite(logs).all()
    rng = random.Random(2)
    words = [word] + ["▁" + "".join(rng.choice("aabbc?") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["a" * 70, "bcbc" * 20]
    want = [language._ahead_logs(language._edges(pieces, [w]), len(w), language._log(language._padded(p)), 1)[-1][0] for w in words]
    for held, lane in ((1 << 15, 64), (7, 64), (7, 1), (50, 1), (100, 20)):
        monkeypatch.setattr(language, "HELD", held)
        monkeypatch.setattr(language, "LANE", lane)
        assert np.allclose(language.forward(pieces, p, words), want), (held, lane)
    rows = [(i, "ka lo mi" if i % 2 else "schei ung", "aa" if i % 2 else "bb") for i in range(40)]
    strange = "\u16a0" * 60
    odd = [(100, strange, "aa"), (101, strange + " ka lo ka lo", "aa"), (102, strange * 100, None), (103, "y" * 5000, None)]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.fit(df)).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[101].lang_pred == "aa"


def test_a_megabyte_of_letters_is_summed_fast():
    import public_tokenizers

    pieces = language.Pieces(language.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    p = np.random.default_rng(3).dirichlet(np.ones(pieces.size), 6).T
    rng, table = random.Random(9), language._padded(p)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "a", "語学習深度模型"):
        word = "▁" + "".join(rng.choice(letters) for _ in range(2**17))
        began = time.process_time()
        language.forward(pieces, p, [word])
        assert time.process_time() - began < 3
        short = word[:200]
        assert np.allclose(language.forward(pieces, p, [short])[0], language._ahead_logs(language._edges(pieces, [short]), 200, language._log(table), 1)[-1][0])


def test_keep_identified(spark):
    df = spark.createDataFrame([(i, "ka lo mi", "aa") for i in range(8)] + [(9, None, "aa"), (10, "12", None), (11, "", "bb"), (None, "lo ka", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.fit(df)
    got = language.keep_identified(df, model)
    assert got.columns == df.columns and sorted((str(r.doc_id), r.lang, r.score) for r in got.collect()) == sorted([(str(i), "aa", "clash") for i in [*range(8), None]])
    assert language.keep_identified(df.limit(0), model).count() == 0


def brute_url(url):
    h = p = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        h = re.split("[/?#]", rest)[0]
        p = re.split("[?#]", rest[len(h) :])[0]
        h = re.sub("[A-Z]", lambda m: m[0].lower(), h)
    fits = [(len(a + b), a + b, v) for v, a, b in urls.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
    _, rule, verdict = max(fits) if fits else (0, None, None)
    whole = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    edge = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", whole)
    return h, p, rule, verdict or ("block" if any(map(edge, urls.STRICT)) or sum(1 for t in urls.SOFT if edge(t)) >= 2 else "allow")


def test_urls(spark):
    cases = [None, "", "nope", "http://Example.ORG/es/1", "http://example.org/en/12", "http://example.org", "http://x.com/de/1", "http://x.com/fr/", "http://a.net/porn/x", "http://a.net/pornography", "http://a.net/free-bet", "http://a.net/free/free", "http://a.net/free?bet", "http://a.net/?q=Porn", "http://a.net/x#casino", "no scheme porn", "http://a.net/" + "p/" * 200_000 + "warez", "http://a.net/paris-sportifs/Free", "x://HOST/a#b://c", "http://notexample.org/es/", "://h/p", "http://free.win.net"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(cases)}
    assert urls.judge(df.limit(0)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(2 * i, words(rng.randint(1, 200), rng, vocabulary)) for i in range(50)] + [(7, None), (9, ""), (11, "short text"), (2000, words(50, rng, vocabulary))]
    rows.append((13, rows[5][1]))
    got = {r.doc_id: r for r in syncmers.fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        q = len(text) // 4
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        mine, edited = ({*filter(None, x.split(","))} for x in (got[i].fingerprint, got[i].edited_fingerprint))
        least = set(sorted(mine | edited, key=lambda x: (int(x, 16) + 2**63) % 2**64)[: syncmers.SKETCH])
        assert got[i].near_edited == pytest.approx(1.0 if not (mine | edited) else len(mine & edited & least) / len(least))
    assert got[13].fingerprint == got[rows[5][0]].fingerprint
    plan = syncmers.fingerprints(docs(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    passage = words(60, rng, vocabulary)
    rows = [(1, words(30, rng, vocabulary) + " " + passage), (2, passage + " " + words(40, rng, vocabulary))]
    found = {}
    for r in syncmers.anchors(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, {})[r.anchor] = r.position
    shared = found[1].keys() & found[2].keys()
    assert len(shared) >= 10 and {found[1][a] - found[2][a] for a in shared} == {30}


def test_fingerprints_have_all_anchors_and_places(spark):
    rng = random.Random(6)
    vocabulary = [f"u{i}" for i in range(5000)]
    passage = words(60, rng, vocabulary)
    rows = [(i, words(3000, rng, vocabulary) + " " + passage + " " + words(3000, rng, vocabulary)) for i in (1, 2)] + [(3, "two words"), (4, "a " * 40 + "b"), (5, "")]
    want = {}
    for r in syncmers.anchors(docs(spark, rows)).collect():
        want.setdefault(r.doc_id, []).append((r.position, r.anchor))
    got = {r.doc_id: r for r in syncmers.fingerprints(docs(spark, rows)).collect()}
    for i in (1, 2, 4):
        assert [tuple(p) for p in got[i].places] == sorted(want[i])
        assert {int(x, 16) for x in got[i].fingerprint.split(",")} == {a % 2**64 for _, a in want[i]}
    assert len(want[1]) > 1500
    a, b = ({a for _, a in want[i]} for i in (1, 2))
    assert a & b and got[1].near_next == pytest.approx(len(a & b) / len(a | b))
    edited = {r.doc_id: r for r in syncmers.fingerprints(docs(spark, rows)).select("doc_id", "edited_fingerprint", "edited_places").collect()}
    assert all({p.anchor % 2**64 for p in r.edited_places} == {int(x, 16) for x in r.edited_fingerprint.split(",") if x} for r in edited.values())
    assert [p.position for p in got[3].places] == [0] and got[5].places == [] and got[5].fingerprint == ""


def test_fingerprints_of_scripts_without_spaces(spark):
    rng = random.Random(8)
    signs = [chr(0x4E00 + i) for i in range(800)] + ["\U00020000", "😀"]
    run = lambda n: "".join(rng.choice(signs) for _ in range(n))
    passage = run(80)
    rows = [(1, run(40) + passage + run(300)), (2, run(90) + passage + run(200)), (3, run(500)), (4, "plain words " * 30)]
    got = {r.doc_id: r for r in syncmers.fingerprints(docs(spark, rows)).collect()}
    places = {i: {p.anchor: p.position for p in got[i].places} for i in got}
    shared = places[1].keys() & places[2].keys()
    assert len(shared) >= 10 and {places[2][a] - places[1][a] for a in shared} == {50}
    assert 0.4 < got[1].near_edited < 0.8 and 0 < got[1].near_next < 0.3 and got[2].near_next == 0
    found = {}
    for r in syncmers.anchors(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, {})[r.anchor] = r.position
    assert all(found[i] == places[i] for i in (1, 2, 3))

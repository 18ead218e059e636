"""Stems, folded words, and the kept index against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.operators import keywords, vectors

# Porter's own examples, and what stays.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
    "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "a": "a", "2024": "2024", "y": "y", "yes": "ye", "naïve": "naïv",
}


def test_stems():
    assert {w: keywords.stem(w) for w in STEMS} == STEMS
    assert keywords.stem("x" * 65 + "ing") == "x" * 65 + "ing"


def test_words_are_folded(spark):
    df = spark.createDataFrame([("Élan naïve CAFÉ-Straße été ÅNGSTRÖM, ñandú! 日本語 don't",), ("",), (None,)], "text string")
    got = [r.w for r in df.select(keywords.words(F.col("text")).alias("w")).collect()]
    assert got == [["elan", "naive", "cafe", "straße", "ete", "angstrom", "nandu", "日本語", "don", "t"], [], []]


def brute(docs, queries, top):
    split = lambda t: [keywords.stem(w) for w in (t or "").lower().split()]
    own = {i: Counter(split(t)) for i, t in docs}
    mean, df, out = sum(sum(c.values()) for c in own.values()) / len(own), Counter(t for c in own.values() for t in c), {}
    for q, text in queries:
        scores = {}
        for i, c in own.items():
            parts = [max(1e-6, math.log((len(own) - df[t] + 0.5) / (df[t] + 0.5))) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in set(split(text)) if c[t]]
            if parts:
                scores[i] = sum(parts)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top]
        out |= {(q, i): s for i, s in best}
    return out


@pytest.mark.parametrize(("block", "whole"), [(128, False), (4, True)])
def test_index_equals_brute_force(spark, tmp_path, monkeypatch, block, whole):
    monkeypatch.setattr(keywords, "LIST", 40)  # frequent terms in several lists
    rng = random.Random(block)
    vocabulary = [f"{rng.choice('bcdf')}{rng.choice('aeiou')}{rng.choice('lmnr')}{n % 37}" + rng.choice(["ing", "ed", "s", ""]) for n in range(80)]
    weights = [1 / (n + 1) for n in range(80)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30)))) for i in range(150)] + [(500, None), (501, "")]
    docs += [(600 + i, docs[3][1]) for i in range(20)]  # ties
    queries = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for i in range(12)] + [(90, "unseen words"), (91, ""), (92, None)]
    df = spark.createDataFrame([*docs, (None, "no id")], "id long, text string")
    keywords.write_index(df, str(tmp_path / "i"), buckets=4)
    index = keywords.read_index(spark, str(tmp_path / "i"))
    got = keywords.search(index, spark.createDataFrame(queries, "query_id long, text string"), 5).collect()
    want = brute(docs, queries, 5)
    assert {(r.query_id, r.id) for r in got} == set(want) and all(abs(r.bm25 - want[r.query_id, r.id]) < 1e-9 and 0 <= r.score <= 1 for r in got)


def test_bounds_leave_blocks_shut(spark, tmp_path):
    """One rare word and a very common one: the common one's blocks name nobody."""
    docs = spark.range(3000).select("id", F.when(F.col("id") % 300 == 0, "rare common filler").otherwise(F.concat(F.lit("common "), F.repeat(F.lit("filler "), (F.col("id") % 9).cast("int")))).alias("text"))
    keywords.write_index(docs, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    _, blocks = keywords.pruned(keywords.read_index(spark, str(tmp_path / "i")), asked, 5)
    opened = {r.opened: r.n for r in blocks.groupBy("opened").agg(F.sum("n").alias("n")).collect()}
    assert opened[True] == 10 and opened[False] == 3000


def test_empty_index(spark, tmp_path):
    keywords.write_index(spark.createDataFrame([], "id long, text string"), str(tmp_path / "i"))
    assert keywords.search(keywords.read_index(spark, str(tmp_path / "i")), spark.createDataFrame([(1, "a b")], "query_id long, text string"), 3).collect() == []


def test_all_queries_at_once_equal_brute_force(spark, monkeypatch):
    """Parts of few documents, ties within and between them, terms that no document has, queries without any."""
    monkeypatch.setattr(keywords, "PART", 25)
    rng = random.Random(9)
    vocabulary = [f"{rng.choice('bcdf')}{rng.choice('aeiou')}{rng.choice('lmnr')}{n % 37}" + rng.choice(["ing", "ed", "s", ""]) for n in range(80)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (n + 1) for n in range(80)], k=rng.randint(0, 30)))) for i in range(150)] + [(500, None), (501, "")]
    docs += [(600 + i, docs[3][1]) for i in range(20)]
    queries = [(i, docs[i][1]) for i in range(0, 150, 5)] + [(900, "unseen words"), (901, ""), (902, None), (903, f"unseen {vocabulary[0]}")]
    counted = keywords.count_terms(spark.createDataFrame([*docs, (None, "no id")], "id long, text string"))
    got = keywords.search_all(counted, spark.createDataFrame(queries, "query_id long, text string"), 5).collect()
    want = brute(docs, queries, 5)
    assert {(r.query_id, r.id) for r in got} == set(want) and all(abs(r.bm25 - want[r.query_id, r.id]) < 1e-9 and 0 <= r.score <= 1 for r in got)
    none = keywords.count_terms(spark.createDataFrame([], "id long, text string"))
    assert keywords.search_all(none, spark.createDataFrame([(1, "a b")], "query_id long, text string"), 3).collect() == []


def written(spark) -> int:
    """Bytes shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_queries_are_not_copied_for_parts(spark, monkeypatch):
    """Four times as many parts of the same documents: what is written stays, where each part got a copy of all queries before."""
    rng, moved = random.Random(4), []
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(800)], "id long, text string")
    counted = spark.createDataFrame(keywords.count_terms(docs).collect(), keywords.COUNTED).coalesce(1)
    for part in (80, 20):
        monkeypatch.setattr(keywords, "PART", part)
        before = written(spark)
        assert keywords.search_all(counted, docs.filter("id % 4 = 0").withColumnRenamed("id", "query_id"), 5).count() == 1000
        moved.append(written(spark) - before)
    assert moved[1] < 1.5 * moved[0]


@pytest.mark.parametrize(("dense", "wide"), [(16, 1024), (2, 3), (10**9, 10**9)])
def test_blocks_in_small_steps_equal_brute_force(monkeypatch, dense, wide):
    """All terms as a matrix, none, or a few; ties of copies in several blocks, postings in few at once, scores that differ by little."""
    for name, value in {"DENSE": dense, "WIDE": wide, "SCORED": 100, "PIECE": 40, "MOST": 200}.items():
        monkeypatch.setattr(keywords, name, value)
    rng = random.Random(dense)
    text = lambda: " ".join(f"{rng.choice('bcdf')}o{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 40)))
    docs = [(i, text()) for i in range(120)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)] + [(2000 + i, docs[9][1] + " " + "same " * (i % 7)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t.split() for _, t in docs], pa.list_(pa.string()))], ["id", "words"])
    blocks = pa.Table.from_batches(keywords._gathered(2, 23, keywords._block)(keywords._counted([batch])))
    assert len(blocks) > 240 / 23 and sum(blocks["n"].to_pylist()) == 240
    df = Counter(t for _, text in docs for t in {keywords.stem(w) for w in text.split()})
    queries = [(i, t) for i, t in docs if i % 3 == 0] + [(900, "unseen"), (901, "")]
    asked = pa.RecordBatch.from_arrays([pa.array([i for i, _ in queries]), pa.array([t.split() for _, t in queries], pa.list_(pa.string()))], ["query_id", "words"])
    found = {}
    for group in pa.Table.from_batches(keywords._gathered(1, 30, keywords._group)(keywords._stemmed([asked])))["asked"]:
        terms = keywords._unpacked(group, "terms")[0].to_pylist()
        known = [i for i, t in enumerate(terms) if t in df]
        idf = np.array([max(1e-6, math.log((240 - df[terms[i]] + 0.5) / (df[terms[i]] + 0.5))) for i in known])
        held = keywords._Group(group, np.array(known, int), idf, 6)
        for packed in blocks["packed"]:
            held.meet(keywords._Block(packed, 1.2, 0.75, sum(blocks["words"].to_pylist()) / 240))
        found |= {(r["query_id"], r["id"]): r["bm25"] for r in held.answers().to_pylist()}
    want = brute(docs, queries, 6)
    assert set(found) == set(want) and all(abs(found[x] - want[x]) < 1e-9 for x in want)


def test_recall_finds_its_candidates_once(spark):
    """Neither ranking nor summary searches again."""
    rng = random.Random(3)
    vec = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id long, embedding array<double>")
    mem = spark.range(60).selectExpr("id", "'pattern' AS memory_type", "id AS access_count", "TIMESTAMP '2024-01-01' AS created_at", "TIMESTAMP '2024-01-02' AS last_accessed_at", "0.5D AS trust_score", "0.5D AS utility_score")
    found = keywords.search_all(keywords.count_terms(vec.select("id", F.concat(F.lit("common w"), F.col("id") % 7).alias("text"))), spark.createDataFrame([(0, "common w0")], "query_id long, text string"), 5)
    ranked, summary = vectors.recall(vec.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), mem, vec, F.lit("2024-01-31").cast("timestamp"), keywords=found, lower=2.0)
    assert [r.n_results for r in summary.orderBy("query_id").collect()] == [30, 30, 30] and ranked.count() > 0
    assert not any("MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString() for df in (ranked, summary))


def test_batches_are_short_only_within_the_search(spark):
    """Blocks pass a few at a time, and the setting is put back after an error, too."""
    before, sizes = spark.conf.get(keywords.BATCH_BYTES), spark.range(64, numPartitions=1).select(F.expr("repeat('x', 1000000)").alias("x"))
    most = lambda: max(r.n for r in sizes.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect())
    with pytest.raises(ValueError, match="stop"), keywords.short_batches(spark):
        assert most() <= 10
        raise ValueError("stop")
    assert spark.conf.get(keywords.BATCH_BYTES) == before and most() > 10

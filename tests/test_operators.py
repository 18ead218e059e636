"""Operators on small inline rows with expected values."""

import datetime as dt
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.functions import rules
from lorebase.functions import text as tx
from lorebase.operators import cells, extract, feedback, graph, hotset, jobs, keywords, memory, sequences, vectors
from lorebase.sources.tables import view

T0 = dt.datetime(2024, 1, 31)


def logs(spark, *texts):
    return spark.createDataFrame([(i, t, T0, "p", 1) for i, t in enumerate(texts)], "log_id long, content string, ts timestamp, project_id string, session_id long")


FOUND = {
    "import": ("from os.path import join", "from os.path import join"),
    "fact": ("This project uses Spark and Parquet", "This project uses Spark and Parquet"),
    "command": ("run `git status --short` now", "git status --short"),
    "code": ("def compute(x):\n  pass", "def compute(...)"),
    "code_block": ("```Python\nprint('a long enough block')\n```", "[python]\nprint('a long enough block')"),
    "decision": ("we settled on plain files in one folder", "plain files in one folder"),
    "architecture": ("the cache handles all session lookups", "cache all session lookups"),
    "tech_stack": ("it is built with redis for speed", "it is built with redis for speed"),
    "explanation": ("we keep it small because memory is scarce here", "we keep it small ... memory is scarce here"),
    "config": ("timeout is 3000ms", "3000ms"),
    "dependency": ("requires numpy >= 1.26", "numpy>=1.26"),
    "api_endpoint": ("GET /v1/items", "GET /v1/items"),
    "entity_technology": ("our redis server is slow", "Technology: Redis"),
    "entity_decision": ("we decided to keep one table per day", "Decision: keep one table per day"),
}


@pytest.mark.parametrize("kind", sorted(FOUND))
def test_extractor_finds(spark, kind):
    text, want = FOUND[kind]
    got = [r.pattern for r in extract.extract(logs(spark, text, "nothing to see"), kind).collect()]
    assert got if want is None else want in got, got


def test_insight_needs_length_and_marker(spark):
    long = "The key insight is that small files slow a scan down, because every file costs a request to the store and a task."
    got = extract.extract(logs(spark, long, "The key insight is short", long.replace("The key insight is", "It seems")), "insight").collect()
    assert [r.log_id for r in got] == [0]


def test_extract_all_keeps_first_kind_of_equal_text(spark):
    got = extract.extract_all(logs(spark, "run `git status --short` and `git status --short`")).filter("kind = 'command'").collect()
    assert len(got) == 1


def test_extract_all_and_mining_reach_entities(spark):
    text = "the postgresql database is slow\nwe decided to keep one table per day because scans are cheap\nThis project uses Spark and Parquet for every table"
    rows = logs(spark, text, "nothing to see", text)
    assert list(extract.EXTRACTORS)[-2:] == ["entity_technology", "entity_decision"]
    got = {(r.log_id, r.kind, r.pattern) for r in extract.extract_all(rows).collect()}
    for kind in ("entity_technology", "entity_decision"):
        alone = {(r.log_id, r.kind, r.pattern) for r in extract.extract(rows, kind).collect()}
        assert alone and alone <= got
    out = jobs.run_mining(rows, None, F.lit(T0))
    kinds = {r.pattern_hash: r.kind for r in out["patterns"].collect()}
    links = {(kinds[r.from_id], kinds[r.to_id], r.relation_type) for r in out["links"].collect()}
    assert ("fact", "entity_decision", "mentions") in links
    assert {r.counter: r.n for r in out["run"].collect()}["links"] == out["links"].count() > 0


@pytest.mark.parametrize(("text", "want"), [("password = abcdefgh1", "password = [REDACTED]"), ("AKIA" + "A1" * 8, "[AWS_KEY_REDACTED]"), ("ghp_" + "a" * 36, "[GITHUB_PAT_REDACTED]"), ("x://u:pw@h", "x://u:[REDACTED]@h"), ("Bearer " + "t" * 20, "Bearer [REDACTED]"), ("plain words", "plain words")])
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    once = df.select(tx.redact(F.col("t")).alias("t"))
    assert once.first().t == want
    assert once.select(tx.redact(F.col("t")).alias("t")).first().t == want


def test_category_priority_and_none(spark):
    df = spark.createDataFrame([("never use this",), ("zzz",), (None,)], "t string")
    assert [r.c for r in df.select(tx.category(F.col("t")).alias("c")).collect()] == ["antipattern", None, None]


def test_repo_normaliser(spark):
    cases = {"git@github.com:a/b.git": "github/a/b", "https://gitlab.com/a/b/": "gitlab/a/b", "ssh://git@bitbucket.org/a/b": "bitbucket/a/b", "nothing": None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.n for r in df.select("u", tx.normalize_repo(F.col("u")).alias("n")).collect()} == cases


def test_trust_is_clamped_in_order(spark):
    base = spark.createDataFrame([(1, 0.95)], "id long, trust_score double")
    for order, want in (([0.15, -0.3], 0.7), ([-0.3, 0.15], 0.8)):
        names = {0.15: "explicitly_confirmed", -0.3: "factually_wrong"}
        events = spark.createDataFrame([(1, i, names[d], None) for i, d in enumerate(order)], "memory_id long, seq long, reason string, similarity double")
        row = hotset.replay_trust(base, events).first()
        assert row.trust == pytest.approx(want)
        assert len(row.history) == 2


def test_trust_of_a_hot_memory_equals_sequential_fold(spark, monkeypatch):
    monkeypatch.setattr(hotset, "BLOCK", 300)
    rng = random.Random(8)
    reasons = sorted(rules.TRUST_CHANGE)
    events = [(1 if i % 3 else i % 5 + 2, 7 * i, rng.choice(reasons), rng.choice([None, rng.random()])) for i in range(3000)]
    base = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.0), (4, 1.0), (5, 0.3), (9, 0.4)], "id long, trust_score double")
    df = spark.createDataFrame(events, "memory_id long, seq long, reason string, similarity double").repartition(3)
    want, steps = {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.3}, []
    for m, seq, reason, similarity in events:
        if m in want:
            d = rules.TRUST_CHANGE[reason]
            d = d * (0.5 + 0.5 * similarity) if d > 0 and similarity is not None else d
            old, want[m] = want[m], min(1.0, max(0.0, want[m] + d))
            steps.append((m, seq, pytest.approx(old), pytest.approx(want[m])))
    got = {r.memory_id: r for r in hotset.last_trust(base, df).collect()}
    assert {m: r.trust for m, r in got.items()} == {m: pytest.approx(x) for m, x in want.items()}
    assert {m: r.n_steps for m, r in got.items()} == {m: sum(s[0] == m for s in steps) for m in want}
    assert [tuple(r) for r in hotset.trust_steps(base, df).orderBy("seq").collect()] == steps
    folded = hotset._folded(base, hotset._in_blocks(df)).filter("memory_id = 1").select(F.explode("blocks").alias("b")).agg(F.max("b.n").alias("most"), F.count("*").alias("n")).first()
    assert folded.n == 7 and folded.most == 300  # no block holds a hot memory whole


def test_markdown_chunks(spark):
    text = "# One\n\nfirst paragraph here\n- item number one\n- item number two\n## Two\nkey: value\n"
    df = spark.createDataFrame([(1, text)], "id long, content string")
    got = [r.chunk for r in memory.chunk_markdown(df, "id").orderBy("block").collect()]
    assert got == ["[One] first paragraph here", "[One] item number one", "[One] item number two", "[Two] key: value"]


def test_issues_skip_bad_lines_and_closed(spark):
    lines = spark.createDataFrame([('{"id":"a","title":"T","description":"D"}',), ("not json",), ('{"id":"b","title":"U","status":"closed"}',)], "value string")
    got = memory.ingest_issues(lines).collect()
    assert [(r.id, r.content, r.tags) for r in got] == [("a", "# T (a)\n\n**Description:** D", ["beads", "task", "p2"])]


def test_binary_flag(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\0b")), (2, bytearray(b"\x01" * 4 + b"abcdef")), (3, bytearray("é text".encode()))], "id int, content binary")
    assert {r.id: r.is_binary for r in memory.flag_binary(df).collect()} == {1: True, 2: True, 3: False}


def test_upsert_adds_copies_to_existing(spark):
    schema = "id long, content string, project_id string, ts long, access_count long, tags array<string>"
    old = spark.createDataFrame([(1, "x", "p", 1, 3, ["a"])], schema)
    new = spark.createDataFrame([(2, "x", "p", 2, 0, ["b"]), (3, "x", "q", 2, 0, None)], schema)
    got = {(r.id, r.access_count, tuple(r.tags)) for r in memory.upsert_exact(old, new).collect()}
    assert (1, 4, ("a", "b")) in got and len(got) == 2


def greedy(nodes, pairs):
    """Sequential star clustering."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, out = set(), {}
    for i, _, pinned in sorted(nodes, key=lambda n: (-n[1], n[0])):
        if pinned or i in taken:
            continue
        members = [j for j in near.get(i, ()) if j not in taken]
        if members:
            taken |= {i, *members}
            out |= dict.fromkeys([i, *members], i)
    return out


def test_star_clusters_equal_greedy(spark):
    rng = random.Random(5)
    nodes = [(i, rng.randint(0, 4), rng.random() < 0.15) for i in range(24)]
    pairs = [(a, b) for a, b in itertools.combinations(range(24), 2) if rng.random() < 0.12]
    mem = spark.createDataFrame(nodes, "id long, access_count long, is_pinned boolean")
    got = vectors.star_clusters(mem, spark.createDataFrame(pairs, "a long, b long")).collect()
    members = {r.id: r.seed_id for r in got}
    assert members == greedy(nodes, pairs)


def vectors_in_groups(n, dim, noise, groups=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = centres[np.arange(n) % groups] + noise * rng.normal(size=(n, dim))
    rows[7], rows[20:30] = 0, rows[8]  # a zero vector, copies
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def cosines(rows):
    m = np.array([v for _, v in rows])
    size = np.linalg.norm(m, axis=1)
    return m @ m.T / np.where(np.outer(size, size) > 0, np.outer(size, size), 1)


@pytest.mark.parametrize(("noise", "threshold", "block"), [(0.05, 0.9, 4096), (0.3, 0.7, 10), (3.0, 0.5, 7), (0.3, -0.1, 16), (0.3, 0.0, 4096)])
def test_similar_pairs_by_cells_lose_nothing(spark, noise, threshold, block):
    rows = vectors_in_groups(150, 8, noise)
    df = spark.createDataFrame([*rows, (900, None)], "id long, embedding array<double>").repartition(3)
    sims = cosines(rows)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if sims[i, j] >= threshold}
    edge = {(i, j) for i in range(150) for j in range(i + 1, 150) if abs(sims[i, j] - threshold) < 1e-9}
    got = [(r.a, r.b) for r in cells.similar_pairs(df, threshold, cell_rows=10, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) - edge == want - edge and want


def test_cells_save_comparisons_where_vectors_are_grouped(spark):
    counts = {}
    for noise in (0.05, 5.0):
        df = spark.createDataFrame(vectors_in_groups(600, 16, noise), "id long, embedding array<double>")
        counts[noise] = cells.compared(cells.pair_groups(df, 0.9, cell_rows=40)).first()
    assert counts[0.05].pairs < 600 * 599 / 2 / 5 and counts[0.05].rows < 700  # hardly any copies
    assert counts[5.0].pairs <= 600 * 599 / 2  # never a pair twice


@pytest.mark.parametrize(("noise", "k", "part"), [(0.05, 3, 16384), (3.0, 12, 16384), (0.3, 5, 11), (0.05, 200, 16384)])
def test_nearest_by_cells_equal_brute_force(spark, monkeypatch, noise, k, part):
    monkeypatch.setattr(cells, "CORPUS_PART", part)
    rows = vectors_in_groups(160, 8, noise)
    df = spark.createDataFrame([*rows, (900, None)], "id long, embedding array<float>").repartition(3)
    asked = df.filter("id % 10 = 0 OR id = 7").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in cells.knn(asked, df, k, cell_rows=10).collect()}
    sims = np.round(cosines([(i, np.float32(v).astype(float)) for i, v in rows]), 12)
    want = {(q, n + 1): i for q in [*range(0, 160, 10), 7] for n, i in enumerate(sorted((i for i in range(160) if i != q), key=lambda i: (-sims[q, i], i))[:k])}
    assert got == want


def test_nearest_with_equal_columns(spark):
    rows = vectors_in_groups(80, 8, 0.3)
    df = spark.createDataFrame([(i, v, f"p{i % 3}") for i, v in rows], "id long, embedding array<double>, project string")
    asked = df.filter("id % 8 = 0").select(F.col("id").alias("query_id"), "embedding", "project")
    got = cells.knn(asked, df, 30, same=["project"], cell_rows=10).collect()
    assert len(got) == sum(sum(1 for i in range(80) if i % 3 == q % 3 and i != q) for q in range(0, 80, 8)) and all(r.id % 3 == r.query_id % 3 for r in got)


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert cells.similar_pairs(none, 0.5).collect() == [] and cells.knn(none.withColumnRenamed("id", "query_id"), none, 3).collect() == []


def test_recall_fuses_keywords_and_gives_events(spark, tmp_path):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.3, 0.954]), (3, [0.3, -0.954]), (4, [0.9, 0.436])], "id long, embedding array<double>")
    mem = spark.createDataFrame([(i, t, 1, T0, T0, 1.0, "pattern", 0.25, "lesson") for i, t in ((1, "zzz"), (2, "spark plans"), (3, "other words"), (4, "nothing"))], "id long, content string, access_count long, created_at timestamp, last_accessed_at timestamp, trust_score double, memory_type string, utility_score double, category string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "balanced"), (2, [0.3, 0.954], "precision")], "query_id long, embedding array<double>, mode string")
    words = spark.createDataFrame([(1, "spark plans")], "query_id long, text string")
    keywords.write_index(mem.select("id", F.col("content").alias("text")), str(tmp_path / "index"))
    found = keywords.search(keywords.read_index(spark, str(tmp_path / "index")), words, 30)
    near = vec.select("id", F.col("embedding"))
    plain, _ = vectors.recall(asked, mem, near, F.lit(T0), lower=0.38)
    ranked, summary = vectors.recall(asked, mem, near, F.lit(T0), keywords=found, lower=0.38)
    assert [r.id for r in plain.filter("query_id = 1").orderBy("rank").collect()] == [4]
    assert [r.id for r in ranked.filter("query_id = 1").orderBy("rank").collect()] == [4, 2]  # lifted by its keywords
    counts = {r.query_id: (r.n_candidates, r.n_gated, r.confidence) for r in summary.collect()}
    assert counts[1] == (3, 1, "high")
    assert {r.query_id: r.guidance for r in summary.collect()}[1] == "use"
    far = vec.filter("id <> 2")  # a memory without a vector is found by its words alone
    both, _ = vectors.recall(asked, mem, far, F.lit(T0), keywords=found, lower=0.5, union=True)
    assert {(r.id, r.similarity) for r in both.filter("query_id = 1 AND id = 2").collect()} == {(2, 0.0)}
    strict, summary = vectors.recall(asked.unionByName(asked.limit(1).withColumn("query_id", F.lit(9)).withColumn("mode", F.lit("precision"))), mem.filter("id = 77"), vec, F.lit(T0))
    assert {(r.query_id, r.guidance, r.n_results) for r in summary.collect()} == {(1, "none", 0), (2, "none_precise", 0), (9, "none_precise", 0)} and strict.count() == 0
    events = feedback.retrieval_events(ranked, F.lit(T0)).collect()
    assert {(e.memory_id, e.was_used, e.created_at) for e in events} >= {(4, False, T0), (2, False, T0)} and len(events) == ranked.count()
    assert len({e.event_id for e in events}) == len(events) and len({e.query_key for e in events}) == 2
    pairs = sequences.transitions(sequences.result_log(ranked, F.lit(T0))).collect()
    assert (4, 2, 1) in {(p.from_id, p.to_id, p["count"]) for p in pairs}


def test_group_results_leaves_small_groups(spark):
    results = spark.createDataFrame([(1, i, i) for i in range(4)], "query_id long, id long, rank int")
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (3, [0.98, 0.0])], "id long, embedding array<double>")
    assert {r.id: r.group for r in vectors.group_results(results, vec).collect()} == {0: 0, 1: 0, 2: None, 3: 0}


def test_hash_embed_is_deterministic_and_overlaps(spark):
    df = spark.createDataFrame([(1, "spark makes plans"), (2, "spark makes plans"), (3, "other words entirely"), (4, "")], "id long, content string")
    v = {r.id: r.embedding for r in vectors.hash_embed(df, "id").collect()}
    assert v[1] == v[2] and v[1] != v[3] and set(v[4]) == {0.0}
    assert sum(x * x for x in v[1]) == pytest.approx(1)


def test_rebuild_reports_failed_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom")], "id long, content string").repartition(1)

    def embedder():
        def run(texts):
            if "boom" in texts:
                raise ValueError("bad text")
            return [[1.0]] * len(texts)

        return run

    got = {r.id: (r.embedding, r.error) for r in vectors.rebuild_vectors(df, embedder, 1, batch=1).collect()}
    assert got[1] == ([1.0], None) and got[2] == (None, "bad text")


def test_expand_and_resolve(spark):
    edges = spark.createDataFrame([(1, 2, "relates_to"), (1, 3, "supersedes"), (4, 1, "contradicts")], "from_id long, to_id long, relation_type string")
    results = spark.createDataFrame([(9, 1, 1, 1.0)], "query_id long, id long, rank int, score double")
    assert {(r.id, r.score) for r in graph.expand(results, edges).collect()} == {(2, 0.8), (4, 0.8)}
    decisions = spark.createDataFrame([(1, 4, "supersede")], "keep_id long, drop_id long, action string")
    left, trust, gone = graph.resolve(edges, decisions)
    assert (1, 4, "supersedes") in {tuple(r) for r in left.collect()} and trust.count() == 1 and gone.count() == 0


def test_pinned_rows_survive_consolidation(spark):
    mem = spark.createDataFrame([(1, 5, False, True), (2, 1, True, False), (3, 1, False, False)], "id long, access_count long, is_pinned boolean, is_hot boolean")
    clusters = spark.createDataFrame([(1, [1, 2, 3], 7)], "representative_id long, member_ids array<long>, total_access long")
    assert {(r.id, r.access_count) for r in vectors.consolidate(mem, clusters).collect()} == {(1, 7), (2, 1)}


@pytest.mark.parametrize("parts", [1, 7])
def test_knn_does_not_depend_on_partitions(spark, parts):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(parts)
    asked = df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = cells.knn(asked, df, 3).collect()
    assert len(got) == 18 and {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in range(0, 60, 10) for k in (1, 2, 3)}


def test_plans(spark):
    folder = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().toString()
    band = plan(feedback.co_occurrence(view(spark, folder, "injections"), F.lit(T0)))
    assert "CartesianProduct" not in band and "BroadcastNestedLoopJoin" not in band
    scan = plan(memory.recent_outputs(view(spark, folder, "output_log"), F.lit(T0), project_id="src3"))
    assert "EqualTo(source,src3)], ReadSchema: struct<doc_id:bigint,text:string,source:string>" in scan
    assert "Python" not in plan(view(spark, folder, "memories").select(tx.category(F.col("content")), tx.importance(F.col("content"))))
    assert "TakeOrderedAndProject" in plan(sequences.all_patterns(sequences.transitions(view(spark, folder, "access_log"))))


def test_relations_are_known():
    assert len(rules.RELATIONS) == 7


def test_many_centroids_are_dealt_out(spark, monkeypatch):
    vec = spark.createDataFrame([(i, [float(i % 7), float(i % 5 - 2), 1.0]) for i in range(40)], "id long, embedding array<double>")
    cents = spark.createDataFrame([(f"c{j}", [float(j), 1.0, float(-j % 3)]) for j in range(6)], "label string, centroid array<double>")
    want = {(r.id, r.label, r.score) for r in vectors.classify_nearest(vec, cents).collect()}
    monkeypatch.setattr(vectors, "MOST_LABELS", 2)
    assert {(r.id, r.label, r.score) for r in vectors.classify_nearest(vec, cents).collect()} == want and len(want) == 40


def test_needed_texts_miss_no_match():
    for patterns in rules.CATEGORY_PATTERNS.values():
        for pattern in patterns:
            texts = tx.needed(re._parser.parse(pattern))
            assert all(x == x.lower() for x in texts)
    assert tx.needed(re._parser.parse(r"\bnever\s+(use|do)\b")) == {"never"} and tx.needed(re._parser.parse(r"(?:ab|cde?)\d")) == {"ab", "cd"}
    assert tx.needed(re._parser.parse(r"[A-Z]+(x?)")) == set()


def test_a_hot_session_is_cut_by_time(spark):
    """A session with half of all rows, ties of time included, against the window over whole sessions."""
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice("wxyz"), rng.randint(0, 200), i) for i in range(400)]
    log = spark.createDataFrame(rows, "session_id string, item string, second int, seq int").withColumn("ts", F.expr("timestamp_seconds(second)"))
    want = sorted(map(tuple, sequences.transitions(log).collect()))
    assert want and all(sorted(map(tuple, sequences.transitions(log, part=part).collect())) == want for part in (7, 150))


def stored_one_by_one(existing, incoming, threshold):
    """The sequential form: (id -> content, accesses, tags, vector of the store, targets)."""
    store = {i: [c, n, set(t), v] for i, c, v, t, n in existing}
    kept, targets = {i: v for i, _, v, _, _ in existing}, {}
    for i, c, v, t, n in sorted(incoming):
        sims = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in kept.items())
        if sims and -sims[0][0] >= threshold:
            row = store[sims[0][1]]
            targets[i] = sims[0][1]
            row[1] += 1
            row[2] |= set(t)
            if len(c) > len(row[0]):
                row[0], row[3] = c, v
        else:
            store[i], kept[i] = [c, n, set(t), v], v
    return store, targets


def test_merges_equal_storing_one_by_one(spark):
    rng, gen = random.Random(2), np.random.default_rng(2)
    centres = gen.normal(size=(9, 6))
    rows = [(i, "x" * rng.randint(1, 30) + str(i), (centres[rng.randrange(9)] + 0.25 * gen.normal(size=6)).tolist(), [rng.choice("abc")], rng.randint(0, 5)) for i in range(70)]
    existing, incoming = rows[:12], rows[12:]
    schema = "id long, content string, embedding array<double>, tags array<string>, access_count long"
    frame = lambda x: spark.createDataFrame(x, schema).withColumns({"last_accessed_at": F.lit(None).cast("timestamp"), "content_hash": F.sha2("content", 256)})
    old, new = frame(existing), frame(incoming)
    targets = vectors.merge_targets(old, new, 0.9)
    got = vectors.semantic_merge(old, new, targets, F.lit(T0)).collect()
    store, want = stored_one_by_one(existing, incoming, 0.9)
    assert {(r.new_id, r.target_id) for r in targets.collect()} == set(want.items()) and any(t >= 12 for t in want.values())
    assert {r.id: (r.content, r.access_count, set(r.tags), r.embedding) for r in got} == {i: (c, n, t, v) for i, (c, n, t, v) in store.items()}
    assert all(r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() and (r.last_accessed_at == T0) == (r.merged > 0) for r in got)


def test_consolidation_unites_tags_and_rewires(spark):
    mem = spark.createDataFrame([(1, 5, False, True, ["a"]), (2, 1, True, False, ["b"]), (3, 1, False, False, ["c", "a"]), (9, 0, False, False, None)], "id long, access_count long, is_pinned boolean, is_hot boolean, tags array<string>")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, seed_id long")
    clusters = vectors.consolidation(members, mem, spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8)], "a long, b long, similarity double"))
    assert {(r.id, r.access_count, tuple(r.tags)) for r in vectors.consolidate(mem, clusters).collect()} == {(1, 7, ("a", "b", "c")), (2, 1, ("b",)), (9, 0, ())}
    edges = spark.createDataFrame([(3, 9, "refines"), (1, 9, "refines"), (9, 3, "mentions"), (1, 3, "mentions"), (2, 9, "mentions")], "from_id long, to_id long, relation_type string")
    assert {tuple(r) for r in vectors.rewire_edges(edges, mem, clusters).collect()} == {(1, 9, "refines"), (9, 1, "mentions"), (2, 9, "mentions")}
    assert vectors.consolidation_savings(clusters).first()[:] == (1, 3, 2, 66.7) and vectors.consolidation_savings(clusters.limit(0)).first().savings_pct == 0


@pytest.mark.parametrize(("block", "session"), [(4096, True), (3, True), (3, False)])
def test_attribution_equals_brute_force(spark, block, session):
    rng = random.Random(6)
    names = [f"mod_{i}.py" for i in range(12)]
    mem = [(i, f"see {rng.choice(names)} and Some{i}Name") for i in range(30)] + [(90, "plain words"), (91, None)]
    told = [(rng.choice([m[0] for m in mem]), 1 if rng.random() < 0.6 else rng.choice([2, 3, None]), rng.randint(0, 200)) for _ in range(150)]
    heard = [(i, rng.choice([1, 1, 2, None]), rng.randint(0, 220), " ".join(rng.sample([*names, "some3name", "MOD_1.PY", "x"], 2))) for i in range(60)] + [(99, 1, 5, None)]
    at = lambda df: df.withColumn("ts", F.expr("timestamp_seconds(hour * 3600)")).drop("hour")
    injections = at(spark.createDataFrame(told, "memory_id long, session_id long, hour int")).withColumnRenamed("ts", "injected_at")
    responses = at(spark.createDataFrame(heard, "response_id long, session_id long, hour int, text string"))
    got = {tuple(r) for r in feedback.attribute_usage(injections, spark.createDataFrame(mem, "id long, content string"), responses, 24, session, block).collect()}
    tokens = {i: [t.lower() for t in (c or "").split() if len(t) >= 6 and re.search(r"[_./:\-0-9]|^.+[A-Z]", t)] for i, c in mem}
    want = {(m, r) for m, s, t in told for r, q, u, text in heard if text and t <= u <= t + 24 and (not session or (s is not None and s == q)) and any(x in text.lower() for x in tokens[m])}
    assert got == want and want


def test_promotion_takes_the_nearest_where_no_text_is_equal(spark):
    mem = spark.createDataFrame([(1, "rows are dealt by hash"), (2, "logs are kept for a week"), (3, "logs are kept for a week")], "id long, content string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = [("logs are kept for a week", 5), ("hash by dealt are rows", 3), ("something else entirely", 4), ("rows are dealt by hash", 1)]
    patterns = spark.createDataFrame([(sha(t), t, n) for t, n in texts], "pattern_hash string, pattern string, count long")
    got = {(r.pattern_hash, r.id) for r in vectors.promotion_targets(patterns, mem, vectors.hash_embed).collect()}
    assert got == {(sha(texts[0][0]), 2), (sha(texts[1][0]), 1)}


def test_texts_are_embedded_once(spark):
    """The search for promoted memories counts, samples and places its vectors; their texts are embedded a single time."""
    seen = spark.sparkContext.accumulator(0)

    def embed(df, key, text):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return vectors.hash_embed(df.mapInArrow(run, df.schema), key, text)

    patterns = spark.createDataFrame([("h1", "alpha beta gamma", 5), ("h2", "delta epsilon", 1)], "pattern_hash string, pattern string, count long")
    mem = spark.createDataFrame([(1, "alpha beta gamma zeta"), (2, "other words")], "id long, content string")
    got = vectors.promotion_targets(patterns, mem, embed, threshold=0.6).collect()
    assert [(r.pattern_hash, r.id) for r in got] == [("h1", 1)] and seen.value == 3


@pytest.mark.parametrize("name", ["vec10_star_clusters", "vec11_consolidation", "vec11_savings", "vec11_rewired_edges", "vec11_consolidate"])
def test_pairs_of_clusters_are_searched_once(spark, monkeypatch, name):
    from lorebase.plans import retrieval

    names, write = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df, what: names.append(what) or write(df, what))
    getattr(retrieval, name)(spark, "/root/testdata/sf0.001")
    assert names[0] == "pairs"


def test_a_search_holds_few_similarities_at_once():
    """256 queries against a part of 16,384 rows in under 40 MB beyond the rows, with the nearest of all (ties: the smaller id) and 0 for vectors without length."""
    rng = np.random.default_rng(5)
    vec, asked = rng.normal(size=(cells.CORPUS_PART, 64)), rng.normal(size=(256, 64))
    vec[7], vec[9], asked[3] = 0, vec[8], 0
    asked[5] = vec[8]
    ids, none = np.arange(len(vec)), np.full(256, -np.inf)
    held = ids, vec, np.sqrt((vec * vec).sum(axis=1)), []
    tracemalloc.start()
    got = {int(q[0]): (i.tolist(), s) for q, i, s in cells.nearest(held, (-1 - np.arange(256), asked, none, []), 5)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    length = np.sqrt((asked * asked).sum(axis=1))[:, None] * held[2]
    sim = np.round(np.where(length > 0, asked @ vec.T / np.where(length > 0, length, 1), 0), 12)
    assert {q: i for q, (i, _) in got.items()} == {-1 - n: np.lexsort((ids, -sim[n]))[:5].tolist() for n in range(256)}
    assert got[-4][0] == [0, 1, 2, 3, 4] and got[-6][0][:2] == [8, 9] and peak < 40 << 20

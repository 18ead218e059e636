"""Expressions tried around the literals that they need find what a search over the whole text finds."""

import datetime as dt
import random
import re

import pytest

from lorebase.functions import literals, rules
from lorebase.functions import text as tx
from lorebase.operators import extract

T0 = dt.datetime(2024, 1, 31)


def keys():
    token = extract._SHARED.set([])
    try:
        for make in extract.EXTRACTORS.values():
            make()
        return extract._SHARED.get()
    finally:
        extract._SHARED.reset(token)


#: Pieces of the expressions themselves, so that random texts hold matches, near misses and overlapping ones.
PIECES = """we decided to use redis because it is fast|instead of kafka use spark|the reason is that|this project uses spark, parquet|
import os.path|from a import b|`git status`|$ ls -la|class Thing(Base):|def load(x) -> int:|async def f():|GET /v1/items|app.post('/x')|requires pandas>=1.2|"numpy==1.0"|
the server uses postgres for caching|worker connects to queue|port = 8080|stored in /var/data|export A_NAME=1|following a layered architecture|data flows from here to there|
react 18.2 client|migrated to react server|in order to|so that|chose|because|since|for|uses|the|   |a||""".replace("\n", "").split("|")


def test_same_matches_as_a_search_of_the_whole_text(spark):
    patterns = list(dict.fromkeys(p for p, _ in keys()))
    expressions = literals.Expressions(patterns)
    assert sum(b is not None for b in expressions.before) > 45  # most are held to their literals
    rng, seen = random.Random(3), set()
    for _ in range(400):
        text = "".join(rng.choice(PIECES) + rng.choice([" ", "\n", "  ", ". ", "İ", "", "\n\n"]) for _ in range(rng.randint(1, 25)))
        text = text.upper() if rng.random() < 0.1 else text
        got = expressions.matches(text)
        for i, p in enumerate(patterns):
            want = [m.span() for m in re.compile(p, re.ASCII).finditer(text)]
            assert [m.span() for m in got.get(i, [])] == want, (p, text)
            seen |= {i} if want else set()
    assert len(seen) > 35


@pytest.mark.parametrize(("pattern", "texts", "before"), [
    (r"(?i)(.{10,100}?)\s+because\s+(.{3})", {"because"}, (100, 1, 0)), (r"(?:the\s+)?(\w+)\s+(?:uses|runs on)", {"uses", "runs on"}, (3, 2, 1)), (r"\d+x?", None, None), (r"[^\n]*port", None, None),
    (r"a(?:bc|de)+f", {"bc", "de"}, (1, 0, 0)), (r"(?:x|\d)key", {"key"}, (1, 0, 0)), (r"É+abc", None, None),
])
def test_needs(pattern, texts, before):
    assert literals.needs(re._parser.parse(pattern)) == (None if texts is None else (texts, before))


def test_long_texts_without_spaces():
    """A word as long as the text widens every window to it; the search is then an ordinary one."""
    expressions = literals.Expressions([r"(\w+)\s+uses\s+(\w+)", r"port\s*=\s*(\d+)"])
    text = "x" * 200_000 + " uses y port = 8080"
    assert {i: [m.span() for m in ms] for i, ms in expressions.matches(text[199_000:]).items()} == {0: [(0, 1007)], 1: [(1008, 1019)]}


SENTENCES = [
    ("We decided to keep a nightly export because the vendor throttles daytime calls", {("decision", "to keep a nightly export because the vendor throttles daytime calls"), ("explanation", "We decided to keep a nightly export ... the vendor throttles daytime calls"), ("entity_decision", "Decision: to keep a nightly export (reason: the vendor throttles daytime calls)")}),
    ("The scheduler manages all retry queues", {("architecture", "scheduler all retry queues")}),
    ("data flows through the staging bucket first", {("architecture", "the staging bucket first")}),
    ("the timeout defaults to 30 seconds", {("config", "timeout 30 seconds")}),
    ("DELETE /v2/users/{id} drops one", {("api_endpoint", "DELETE /v2/users/{id}")}),
    ("pip install requests==2.31.0", {("dependency", "requests==2.31.0")}),
    ("Storage is persisted with sqlite and the app was migrated to Django", {("entity_technology", "Technology: Sqlite"), ("entity_technology", "Technology: Django")}),
    ("Authentication is handled by a signed cookie", {("fact", "Authentication is handled by a signed cookie")}),
    ("async def fetch_page(url) -> str:\n    ...", {("code", "def fetch_page(...)")}),
    ("from json import loads", {("import", "from json import loads")}),
]


def test_sentences_of_several_shapes(spark):
    """Expected values written by hand; an extractor may tell more of a sentence."""
    logs = spark.createDataFrame([(i, t, T0, "p", 1) for i, (t, _) in enumerate(SENTENCES)] + [(99, None, T0, "p", 1), (98, "", T0, "p", 1)], "log_id long, content string, ts timestamp, project_id string, session_id long")
    got = {}
    for r in extract.extract_all(logs).collect():
        got.setdefault(r.log_id, set()).add((r.kind, r.pattern))
    for i, (_, want) in enumerate(SENTENCES):
        assert {(k, p) for k, p in want if p not in {p for _, p in got.get(i, ())}} == set(), got.get(i)
    single = {k: {(r.log_id, r.pattern) for r in extract.extract(logs, k).collect()} for k in ("decision", "architecture", "config", "fact")}
    assert all(pattern in {p for _, p in got[i]} for finds in single.values() for i, pattern in finds)


def test_categories_at_hits_are_those_of_whole_searches(spark):
    """Both forms of the category, on pieces of the expressions and beside letters that are not ASCII, where SQL's word boundaries lie."""
    pieces = ["don't", "use", "instead", "because", " chose", "warning", "first", "then", "run", "v", "1.2", "see", "file", "fix", "\n", "git status", "[java]", "--all", " ", " ", "é", "ñ", "never ", "it is", "✓ "]
    rng = random.Random(3)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500)] + ["ami doñdev el server", "únext se run", None, ""]

    def want(text):
        n = {c: sum(bool(re.search(p, text or "", re.I | re.M | re.A)) for p in rules.CATEGORY_PATTERNS[c]) for c in rules.CATEGORY_PRIORITY}
        best = max(n, key=lambda c: n[c])
        return best if n[best] else None

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = rows.select("id", tx.category(rows["t"]).alias("native"), tx.category_at_hits(rows["t"]).alias("hits")).orderBy("id").collect()
    assert [r.hits for r in got] == [want(t) for t in texts]
    assert [r.native for r in got] == [r.hits for r in got]
    assert got[1500].hits == got[1501].hits == "workflow"


def test_presence_passes_common_words_by():
    """Places stay in their order when letters are lowered, and words that nearly every text holds are no hits of the pass."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    low = literals.lowered(every)
    assert len(low) == len(every) and low[:128] == every[:128].lower() and literals.lowered("İK") == "ık"
    presence, _ = tx._categories()
    common = "the man that goes to do the work is not the one who did the other " * 100
    assert sum(1 for _ in presence.automaton.iter(common)) <= 200 and not any(presence.found(common))  # "go" and nothing else
    assert tx.category_of("İ" * 50 + " The RULE is") == "convention" and tx.category_of("İİ Never Use it, K") == "antipattern"
    expressions = literals.Expressions([r"\bUSES\s+(\w+)"])
    assert [m.span() for m in expressions.matches("İ" * 40 + " USES Spark, USES İ uses")[0]] == [(41, 51)]


class Counted:
    """An expression that counts how often it is tried."""

    def __init__(self, pattern):
        self.pattern, self.tried = pattern, 0

    def match(self, text, at):
        self.tried += 1
        return self.pattern.match(text, at)


def test_long_lines_are_not_run_through_again_from_every_word():
    """A line without the second word is passed once, or the work would grow with the square of its length."""
    own = [p for ps in rules.CATEGORY_PATTERNS.values() for p in ps if ".*" in p]
    presence = literals.Presence(own, re.IGNORECASE | re.MULTILINE)
    assert len(own) == 8
    presence.patterns = counted = [Counted(p) for p in presence.patterns]
    for head, second in (("because", "users"), ("then", "done"), ("step  3", "runs"), ("api", "designs"), ("don't", "insteads")):
        assert not any(presence.found(f"{head} it rains, {second} ... " * 3000))
    assert sum(c.tried for c in counted) < 100
    assert sum(presence.found("then it rains, done ... " * 3000 + "do")) == 1


def test_presence_is_that_of_a_plain_search():
    """Words of "head.*tail" in any order, heads that go over the end of a line, and tails that overlap them."""
    patterns = [p for ps in rules.CATEGORY_PATTERNS.values() for p in ps if ".*" in p] + [r"a(b|bc?\s*c).*c\s*d", r"x\n?y.*y\sz", r"(ab|a\s*\n).*b", r"api.*see.*do"]
    flags = re.IGNORECASE | re.MULTILINE
    presence, plain = literals.Presence(patterns, flags), [re.compile(p, flags | re.ASCII) for p in patterns]
    assert [line is not None for line in presence.lines] == [True] * 12
    words = ["don't", "instead", "because", "chose", "use", "step", "2", "first", "then", "run", "do", "api", "s", "design", "see", "refer to", "file", "ab", "abc", "c", "d", "x", "y", "z", "a", "b", "é", "İ", "_", "long words stand here"]
    rng, n = random.Random(5), [0] * len(patterns)
    for _ in range(6000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "   ", "\n", "\n\n", "\t", "\r\n"]) for _ in range(rng.randint(1, 30)))
        want = [p.search(text) is not None for p in plain]
        assert presence.found(text) == want, text
        n = [a + b for a, b in zip(n, want, strict=True)]
    assert sum(x > 20 for x in n) >= 7
    assert [literals.Line.of(p, 0) for p in (r"(a.*b)", r"\w+.*b", r"(a).*\1", "ab", ".*b")] == [None] * 5 and literals.Line.of("a.*b", re.DOTALL) is None


def test_categories_of_odd_letters_are_those_of_sql():
    """SQL takes two letters beyond ASCII for s and k, also as word letters, but not at word boundaries; a vertical tab is no white space to it."""
    import duckdb
    import pyarrow as pa

    from lorebase.plans import store

    words = ["i\u017fsue", "iss\u017fue", "hac\u212a", "bro\u212aen", "u\u017fe", "never", "don't", "instead", "because", "\u017ftep 1", "run", "see", "file", "fi\u212a --\u017f", "a-\u212a -x", "./\u017f\u212a.sh", "git \u017fta\u212a", "\u212a", "!", "found", "12", "ssh", "https://\v", "v", "1.2"]
    rng = random.Random(3)
    texts = ["!\v", "i\u017fsue", "use", "fi\u212a -x "] + ["".join(rng.choice(words) + rng.choice([" ", "\v", "\n", "\f", "\r\n", "\x85", "\u2028", "\xa0", "\x1c", "\0", ""]) for _ in range(rng.choice([1, 2, 3, 6, 12]))) for _ in range(3000)]
    with duckdb.connect() as con:
        con.register("memories", pa.table({"id": range(len(texts)), "content": texts}))
        want = dict(con.execute(store._category_sql()).fetchall())
    assert [want[i] for i in range(4)] == [None, "bug", None, "command"] and len(set(want.values())) > 8
    assert {t: tx.category_of(t) for t in texts} == {t: want[i] for i, t in enumerate(texts)}


def test_finds_of_costly_kinds_come_in_small_batches(spark):
    """One kind alone takes its finds from the shared pass, as all together do, and a task holds STEP texts' finds at most."""
    import pyarrow as pa

    rows = [(i, f"we use redis server {i} because it is fast and cheap; chose redis, built with React app") for i in range(50)] + [(90, None), (91, "nothing")]
    logs = spark.createDataFrame([(i, t, T0, "p", 1) for i, t in rows], "log_id long, content string, ts timestamp, project_id string, session_id long")
    for kind in ("tech_stack", "explanation", "entity_technology"):
        one = extract.extract(logs, kind)
        assert "MapInArrow" in one._jdf.queryExecution().toString()
        both = extract.extract_all(logs, [kind])
        assert sorted({(r.log_id, r.pattern) for r in one.collect()}) == sorted((r.log_id, r.pattern) for r in both.collect()) != []
    batch = pa.RecordBatch.from_arrays([pa.array(["x because y"] * (2 * literals.STEP + 1))], ["content"])
    assert [b.num_rows for b in literals.finder([("because", 0)], "content")([batch])] == [literals.STEP, literals.STEP, 1]


def test_tasks_of_notes_do_not_grow(spark, tmp_path, monkeypatch):
    from lorebase.plans import extraction

    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE '2024-01-01' AS o_orderdate").repartition(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(extraction, "NOTES_A_TASK", 100)
    assert extraction.notes(spark, str(tmp_path)).rdd.getNumPartitions() == 10


@pytest.mark.parametrize(("group", "dealt"), [(4000, True), (200, False)])
def test_a_large_row_group_is_dealt_out(spark, tmp_path, group, dealt):
    """A scan has a part for so many bytes, but all rows of a row group in one of them; well-laid tables are left as they are."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lorebase.sources.tables import spread

    rng = random.Random(3)
    rows = pa.table({"id": range(4000), "t": ["".join(rng.choices("abcdefghij", k=60)) for _ in range(4000)]})
    pq.write_table(rows, tmp_path / "t.parquet", row_group_size=group, use_dictionary=False, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spread(spark.read.parquet(str(tmp_path / "t.parquet")))
        sizes = [len(p) for p in df.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) > 8 and sum(sizes) == 4000 and max(sizes) < 1000
    assert ("Exchange" in df._jdf.queryExecution().toString()) == dealt

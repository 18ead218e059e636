"""Queries of the extractors and of ingest, over texts that are made from the rows of orders, with SQL.

Each order becomes a note: a template by its key's remainder, with its key, customer and date put in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import rules
from lorebase.operators import extract, feedback, graph, jobs, memory
from lorebase.plans.registry import lit, query
from lorebase.sources.tables import AS_OF, as_of, load, spread, view

NOTES = [
    "import numpy.linalg, table{key}\nfrom pyspark.sql import functions as F\nprint(1)\nimport os",
    "This project uses Spark and Parquet table {key} daily. We use Redis for caching orders of {cust} quickly",
    "$ git status --short {key}\nsee `pytest tests/unit_{cust}.py` and `python -m build {cust}`\n> docker build image{key}\ntext",
    "class Order{key}(Base):\n    def load_{cust}(self, x):\n        pass\ndef _hidden(a):\nasync def fetch{key}(a, b) -> int:",
    "We decided to keep one table per day {key} because scans are cheap for customer {cust}. In other news nothing",
    "The gateway {cust} service handles order {key} events. worker communicates with queue {key}",
    "The cache is small {key} so that memory stays bounded for tenant {cust}",
    "the timeout defaults to {cust} seconds; stored in /var/data/orders/{key}\nexport ORDER_LIMIT={key}\nexport API_TOKEN=abc",
    'requires pandas>={cust}.1\npip install numpy=={cust}.2 \n"scipy>=1.{key}"\nnumpy=={cust}.2',
    "GET /v1/orders/{key}\n@app.post('/v1/customers/{cust}')\nplain text GET /v1/orders/{key}",
    "Our service runs on PostgreSQL server {key}, built with React for the frontend. Uses Redis for order {cust}",
    "We went with Kafka {key} instead of RabbitMQ {cust} for speed. The decision was to ship order {key} early",
    "```python\nx = {key}\nfor row in table_{cust}: print(row)\n```\ntext\n```\nshort\n```\n```\nError: order {key} was not found\n```",
    "In summary, order {key} shows that customers such as {cust} come back often, and the reason is the low price that the shop keeps.\n\nA short end of {date}",
]
#: A task's notes, so that its time does not grow with the table.
NOTES_A_TASK = 100_000
_PUT = {"{key}": "o_orderkey", "{cust}": "o_custkey", "{date}": "o_orderdate"}


def notes(spark, d):
    """log_id, content, ts, project_id, session_id."""
    return noted(spread(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), NOTES_A_TASK))


def noted(orders):
    text = F.element_at(F.array(*[F.lit(n) for n in NOTES]), (F.col("o_orderkey") % len(NOTES) + 1).cast("int"))
    for name, column in _PUT.items():
        value = F.date_format(column, "yyyy-MM-dd") if column == "o_orderdate" else F.col(column).cast("string")
        text = F.replace(text, F.lit(name), value)
    return orders.select(F.col("o_orderkey").alias("log_id"), text.alias("content"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("project_id"), (F.col("o_custkey") % 20).alias("session_id"))


def _notes_sql() -> str:
    text = "CASE o_orderkey % " + str(len(NOTES)) + " " + " ".join(f"WHEN {i} THEN {lit(n)}" for i, n in enumerate(NOTES)) + " END"
    for name, column in _PUT.items():
        text = f"replace({text}, '{name}', {f'strftime({column}, {lit("%Y-%m-%d")})' if column == 'o_orderdate' else f'CAST({column} AS VARCHAR)'})"
    return f"notes AS MATERIALIZED (SELECT o_orderkey AS log_id, {text} AS content, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)"


def _all(pattern: str, group: int, flags: str = "") -> str:
    return f"regexp_extract_all(content, {lit(flags + pattern)}, {group})"


def _joined(pattern: str, n: int, join: str, flags: str = "(?i)") -> str:
    if n == 0:
        return f"list_transform({_all(f'({pattern})', 1, flags)}, lambda x: trim(x))"
    if n == 1:
        return f"list_transform({_all(pattern, 1, flags)}, lambda x: trim(x))"
    return f"list_transform(list_zip({_all(pattern, 1, flags)}, {_all(pattern, 2, flags)}), lambda x: trim(concat_ws({lit(join)}, nullif(x[1], ''), nullif(x[2], ''))))"


def _between(array: str, lo: int, hi: int) -> str:
    return f"list_filter({array}, lambda x: length(x) > {lo} AND length(x) < {hi})"


def _concat(*arrays: str) -> str:
    out = arrays[0]
    for a in arrays[1:]:
        out = f"list_concat({out}, {a})"
    return out


def _rows(array: str, confidence) -> str:
    return f"SELECT log_id, x AS pattern, CAST({confidence} AS DOUBLE) AS confidence FROM (SELECT log_id, unnest({array}) AS x FROM notes)"


def _listed(patterns, join: str, lo: int, hi: int, confidence: float) -> str:
    return _rows(_between(_concat(*[_joined(p, n, join) for p, n in patterns]), lo, hi), confidence)


_STRIPPED = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_COMMAND = r"(?:^|\n)[$>]\s*(.+?)(?:\n|$)|`([^`]+)`|(?:run|execute|use):\s*`([^`]+)`"
_PACKAGES = [p.replace("{P}", extract._PACKAGE) for p in (r"(?:requires?|needs?|depends on|dependency:?)\s*({P})", "^({P})", r"pip install[^\n]*?({P})", '"({P})"')]
_MARKERS = "(?i)" + "|".join(extract.INSIGHTS)
_FIRST_MARKERS = "(?i)" + "|".join(extract.INSIGHTS[:8])


def _found(patterns, columns) -> str:
    """Rows (log_id, n, i, a, b) of all matches in order."""
    return " UNION ALL ".join(f"SELECT log_id, {n} AS n, unnest(generate_series(1, len(z))) AS i, unnest(z)[1] AS a, unnest(z)[2] AS b, content FROM (SELECT log_id, content, list_zip({columns(p)[0]}, {columns(p)[1]}) AS z FROM notes)" for n, p in enumerate(patterns))


def _tech_stack() -> str:
    found = _found(extract.TECH_STACK, lambda p: (_all(f"({p})", 1, "(?i)"), _all(f"({p})", 2, "(?i)")))
    context = "trim(regexp_replace(substr(content, instr(content, a) - least(instr(content, a) - 1, 30), least(instr(content, a) - 1, 30) + length(a) + 30), '\\s+', ' ', 'g'))"
    return f"SELECT log_id, c AS pattern, CAST(0.85 AS DOUBLE) AS confidence FROM (SELECT log_id, {context} AS c FROM ({found}) QUALIFY row_number() OVER (PARTITION BY log_id, lower(b) ORDER BY n, i) = 1) WHERE length(c) > 10"


def _entity_decisions() -> str:
    flags = {p: (rationale, alternative, inverted) for p, rationale, alternative, inverted in extract.DECISION_ENTITIES}
    found = _found(list(flags), lambda p: (_all(p, 1, "(?i)"), _all(p, 2 if flags[p][0] or flags[p][1] else 1, "(?i)")))
    of = lambda i: "CASE n " + " ".join(f"WHEN {n} THEN {str(f[i]).upper()}" for n, f in enumerate(flags.values())) + " END"
    return f"""SELECT log_id, 'Decision: ' || one || CASE WHEN alternative THEN ' (over ' || two || ')' WHEN rationale THEN ' (reason: ' || two || ')' ELSE '' END AS pattern, CAST(CASE WHEN alternative THEN 0.8 WHEN rationale THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence
FROM (SELECT *, trim(CASE WHEN inverted THEN b ELSE a END) AS one, trim(CASE WHEN inverted THEN a ELSE b END) AS two FROM (SELECT *, {of(0)} AS rationale, {of(1)} AS alternative, {of(2)} AS inverted FROM ({found})))
QUALIFY row_number() OVER (PARTITION BY log_id, substr(lower(one), 1, 50) ORDER BY n, i) = 1"""


KINDS = {
    "import": _rows(r"list_filter(list_transform(" + _all(r"^(from\s+[\w.]+\s+import\s+[\w,\s*]+|import\s+[\w,\s.]+)$", 1, "(?m)") + r", lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 10)", 0.5),
    "fact": _rows(_between(_concat(*[_joined(p, 0, "", "") for p in extract.FACTS]), 10, 200), 0.5),
    "command": _rows("list_filter(" + _between(f"list_transform(list_zip({', '.join(_all(_COMMAND, g, '(?m)') for g in (1, 2, 3))}), lambda x: trim(coalesce(nullif(x[1], ''), nullif(x[2], ''), x[3])))", 5, 200) + f", lambda x: regexp_matches(x, {lit('^(?:' + '|'.join(rules.COMMAND_STARTS) + ')')}))", 0.5),
    "code": _rows(_concat("list_transform(list_filter(" + _all(r"(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*(?:->[\w\[\],\s|]+)?:", 1) + ", lambda x: NOT starts_with(x, '_')), lambda x: 'def ' || x || '(...)')", "list_transform(" + _all(r"class\s+(\w+)\s*(?:\([^)]*\))?:", 1) + ", lambda x: 'class ' || x)"), 0.5),
    "code_block": "SELECT log_id, CASE WHEN l <> '' THEN '[' || l || ']' || chr(10) || c ELSE c END AS pattern, CAST(CASE WHEN l <> '' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM (SELECT log_id, lower(x[1]) AS l, " + _STRIPPED.format("x[2]") + " AS c FROM (SELECT log_id, unnest(list_zip(" + _all(r"```(\w*)\n(.*?)```", 1, "(?s)") + ", " + _all(r"```(\w*)\n(.*?)```", 2, "(?s)") + r")) AS x FROM notes)) WHERE length(c) BETWEEN 20 AND 2000 AND NOT regexp_matches(c, '^(?:Error:|Traceback)')",
    "decision": _listed(extract.DECISIONS, " → ", 10, 200, 0.8),
    "architecture": _listed(extract.ARCHITECTURE, " ", 10, 200, 0.75),
    "tech_stack": _tech_stack(),
    "explanation": _listed(extract.EXPLANATIONS, " ... ", 20, 300, 0.6),
    "insight": r"SELECT log_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS pattern, CAST(CASE WHEN regexp_matches(x, " + lit(_FIRST_MARKERS) + ") THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence FROM (SELECT log_id, " + _STRIPPED.format("p") + r" AS x FROM (SELECT log_id, unnest(regexp_split_to_array(content, '\n\s*\n')) AS p FROM notes)) WHERE length(x) BETWEEN 100 AND 800 AND NOT starts_with(x, '```') AND length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 0.5 * length(x) AND regexp_matches(x, " + lit(_MARKERS) + ")",
    "config": _rows(_between(_concat(*[_joined(p, n, " ") for p, n in extract.CONFIG]), 3, 150), 0.65) + " UNION ALL " + _rows("list_transform(list_filter(" + _all(r"(?:set|export)\s+([A-Z_][A-Z0-9_]+)\s*=", 1) + f", lambda x: NOT regexp_matches(lower(x), {lit('|'.join(rules.SENSITIVE_NAMES))})), lambda x: x || ' environment variable is configured')", 0.5),
    "dependency": "SELECT DISTINCT * FROM (" + _rows("list_filter(list_transform(" + _concat(*[_all(p, 1, "(?im)") for p in _PACKAGES]) + r", lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: length(x) > 5)", 0.85) + ")",
    "api_endpoint": "SELECT DISTINCT * FROM (" + _rows("list_filter(" + _concat(*[f"list_transform(list_zip({_all(p, 1, '(?i)')}, {_all(p, 2, '(?i)')}), lambda x: upper(x[1]) || ' ' || x[2])" if n == 2 else _all(p, 1, "(?i)") for p, n in extract.ENDPOINTS]) + ", lambda x: length(x) > 3)", 0.9) + ")",
    "entity_technology": "SELECT DISTINCT * FROM (" + _rows("list_transform(" + _concat(*[_all(p, 1, "(?i)") for p in extract.TECH_ENTITIES]) + ", lambda x: 'Technology: ' || upper(x[1]) || lower(x[2:]))", 0.85) + ")",
    "entity_decision": _entity_decisions(),
}
_NUMBERS = {"import": "ext01", "fact": "ext02", "command": "ext03", "code": "ext04", "code_block": "ext05", "decision": "ext06", "architecture": "ext07", "tech_stack": "ext08", "explanation": "ext09", "insight": "ext10", "config": "ext11", "dependency": "ext12", "api_endpoint": "ext13", "entity_decision": "ext14", "entity_technology": "txt10"}


def _register(kind: str) -> None:
    def run(spark, d):
        return extract.extract(notes(spark, d), kind).groupBy("log_id", "pattern", "confidence").agg(F.count("*").alias("n"))

    run.__name__ = f"{_NUMBERS[kind]}_{kind}"
    query(f"WITH {_notes_sql()} SELECT log_id, pattern, confidence, count(*) AS n FROM ({KINDS[kind]}) GROUP BY ALL")(run)


for _kind in KINDS:
    _register(_kind)

#: What all extractors find in notes (log_id, content, ts): a text once per log, under its first kind.
FOUND = "found AS (SELECT log_id, pattern, min_by(kind, n) AS kind FROM (" + " UNION ALL ".join(f"SELECT log_id, pattern, {lit(k)} AS kind, {n} AS n FROM ({s})" for n, (k, s) in enumerate((k, KINDS[k]) for k in extract.EXTRACTORS)) + ") GROUP BY 1, 2)"
BY_KIND = " SELECT kind, count(*) AS n, count(DISTINCT log_id) AS n_logs FROM found GROUP BY 1"
_UNION = f"WITH {_notes_sql()}, {FOUND}"


@query(_UNION + BY_KIND)
def ext15_union(spark, d):
    return extract.extract_all(notes(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("log_id").alias("n_logs"))


MINED = _UNION + " SELECT sha256(pattern) AS pattern_hash, count(*) AS count, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM found JOIN notes USING (log_id) WHERE length(pattern) >= 30 GROUP BY pattern"


@query(MINED)
def min01_extracted(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return extract.aggregate_patterns(extract.extract_all(notes(spark, d))).select("pattern_hash", "count", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


RUN = FOUND + f""", patterns AS MATERIALIZED (SELECT sha256(pattern) AS id, min({{'t': ts, 'i': log_id, 'k': kind}}) AS one, count(*) AS n FROM found JOIN notes USING (log_id) WHERE length(pattern) >= 30 AND NOT regexp_matches(pattern, {lit('(?i)' + '|'.join(rules.SECRET_SIGNS))}) GROUP BY pattern),
admitted AS MATERIALIZED (SELECT id, one.i AS log_id, one.k AS kind FROM patterns WHERE one.k NOT IN ('command', 'snippet')),
links AS (SELECT DISTINCT a.id, b.id FROM admitted a JOIN admitted b USING (log_id) WHERE a.id <> b.id AND starts_with(b.kind, 'entity_') AND (NOT starts_with(a.kind, 'entity_') OR (a.kind = 'entity_decision' AND b.kind = 'entity_technology')))"""
COUNTERS = " SELECT 'logs' AS counter, count(*) AS n FROM notes " + " ".join(f"UNION ALL SELECT '{c}', count(*) FROM {t}" for c, t in {"found": "found", "patterns": "patterns", "new_patterns": "patterns", "admitted": "admitted", "frequent": "patterns WHERE n >= 3", "links": "links"}.items())


@query(f"WITH {_notes_sql()}, {RUN}{COUNTERS}")
def min08_counters(spark, d):
    """A whole mining run over the notes: all extractors, aggregation, admission, entity links."""
    return jobs.run_mining(notes(spark, d), None, as_of())["run"]


@query("SELECT 'I-' || o_orderkey AS id, '# Order ' || o_custkey || ' (I-' || o_orderkey || ')' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '**Description:** from ' || o_orderpriority ELSE '' END AS content, CASE WHEN o_orderkey % 5 = 0 THEN 'beads,bug,p1' ELSE 'beads,task,p2' END AS tags FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 7 <> 0")
def src04_issues(spark, d):
    """Exported issues, one for each order; every seventh line is no JSON, every second issue has no description."""
    none = F.lit(None)
    issue = F.struct(
        F.concat(F.lit("I-"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_custkey").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("from "), "o_orderpriority")).alias("description"),
        F.when(F.col("o_orderstatus") == "F", "closed").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(1)).otherwise(none.cast("int")).alias("priority"), F.when(F.col("o_orderkey") % 5 == 0, "bug").alias("issue_type"),
    )
    lines = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("{broken "), "o_orderkey")).otherwise(F.to_json(issue)).alias("value"))
    return memory.ingest_issues(lines).select("id", "content", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id, doc_id % 5 = 0 OR (doc_id % 5 = 1 AND length(coalesce(text, '')) < 100) AS is_binary FROM documents")
def src06_binary(spark, d):
    """Every fifth text begins with a NUL byte; the next one has a hundred odd control bytes in front."""
    front = F.when(F.col("doc_id") % 5 == 0, F.lit("\x00")).when((F.col("doc_id") % 5 == 1) & (F.char_length(F.coalesce("text", F.lit(""))) < 100), F.lit("\x01" * 100)).otherwise(F.lit(""))
    files = load(spark, d, "documents").select("doc_id", F.concat(front, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return memory.flag_binary(files).select("doc_id", "is_binary")


@query("SELECT o_orderkey AS id, unnest(['[Order ' || o_orderkey || '] customer number ' || o_custkey, '[Order ' || o_orderkey || '] status: ' || o_orderstatus, '[History] placed on a day' || chr(10) || 'with priority ' || o_orderpriority]) AS chunk FROM orders")
def src08_markdown(spark, d):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("# Order "), key, F.lit("\n\n- customer number "), cust, F.lit("\n* status: "), "o_orderstatus", F.lit("\n- tiny\n## History\nplaced on a day\nwith priority "), "o_orderpriority", F.lit("\n\n"))
    files = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("content"))
    return memory.chunk_markdown(files, "id").select("id", "chunk")


_DECIDED = "decided AS (SELECT from_id AS keep_id, to_id AS drop_id, CASE (from_id + to_id) % 3 WHEN 0 THEN 'supersede' WHEN 1 THEN 'delete' ELSE 'weaken' END AS action FROM edges WHERE relation_type = 'contradicts' AND from_id < to_id AND from_id % 2 = 0)"


@query("+" + _DECIDED + """, kept AS (SELECT from_id, to_id, relation_type FROM edges WHERE relation_type <> 'contradicts' OR NOT ((from_id, to_id) IN (SELECT keep_id, drop_id FROM decided) OR (to_id, from_id) IN (SELECT keep_id, drop_id FROM decided))),
after AS (SELECT * FROM kept UNION SELECT keep_id, drop_id, 'supersedes' FROM decided WHERE action = 'supersede')
SELECT 'edges ' || relation_type AS part, count(*) AS n, CAST(sum(from_id * 31 + to_id) AS BIGINT) AS ids, CAST(NULL AS DOUBLE) AS delta FROM after GROUP BY 1 UNION ALL SELECT 'trust', count(*), CAST(sum(drop_id) AS BIGINT), CAST(CASE action WHEN 'supersede' THEN -0.2 ELSE -0.3 END AS DOUBLE) FROM decided WHERE action <> 'delete' GROUP BY 4 UNION ALL SELECT 'delete', count(*), CAST(sum(drop_id) AS BIGINT), NULL FROM decided WHERE action = 'delete'""", "edges")
def gra08_resolve(spark, d):
    edges = view(spark, d, "edges").select(graph.EDGE)
    action = F.element_at(F.array(F.lit("supersede"), F.lit("delete"), F.lit("weaken")), ((F.col("from_id") + F.col("to_id")) % 3 + 1).cast("int"))
    decided = edges.filter("relation_type = 'contradicts' AND from_id < to_id AND from_id % 2 = 0").select(F.col("from_id").alias("keep_id"), F.col("to_id").alias("drop_id"), action.alias("action"))
    after, trust, gone = graph.resolve(edges, decided)
    none = F.lit(None).cast("double")
    parts = [
        after.groupBy(F.concat(F.lit("edges "), "relation_type").alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("from_id") * 31 + F.col("to_id")).alias("ids"), none.alias("delta")),
        trust.groupBy("delta").agg(F.lit("trust").alias("part"), F.count("*").alias("n"), F.sum("memory_id").alias("ids")),
        gone.agg(F.lit("delete").alias("part"), F.count("*").alias("n"), F.sum("id").alias("ids"), none.alias("delta")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT sha256(query_key) AS query_key, memory_id, similarity, FALSE AS was_used, CAST(epoch_us({AS_OF}) AS BIGINT) AS created_us, count(*) AS n FROM retrievals GROUP BY ALL", "retrievals")
def ret01_events(spark, d):
    ranked = view(spark, d, "retrievals").select(F.col("query_key").alias("query_id"), F.col("memory_id").alias("id"), "similarity")
    events = feedback.retrieval_events(ranked, as_of())
    return events.groupBy("query_key", "memory_id", "similarity", "was_used", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us")).agg(F.count("*").alias("n"))

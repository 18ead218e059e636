"""Queries over stored rows, logs, sequences, feedback, the hot set, the graph and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import rules, scores
from lorebase.functions import text as tx
from lorebase.operators import extract, feedback, graph, hotset, jobs, memory, reports, sequences, sessions
from lorebase.plans import extraction
from lorebase.plans.registry import AS_OF, SCOPE, case, days, hot_score, lit, query, recency, salience, trust_now
from lorebase.sources.tables import as_of, load, spread, view

# Sequences

TRANS = """+pairs AS (SELECT {item} AS from_id, lead({item}) OVER w AS to_id, lead(ts) OVER w AS seen FROM access_log WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
trans AS (SELECT from_id, to_id, count(*) AS n, max(seen) AS last_seen FROM pairs WHERE to_id IS NOT NULL AND from_id <> to_id GROUP BY 1, 2),
prob AS (SELECT *, n / sum(n) OVER (PARTITION BY from_id) AS p FROM trans) """
BY_TYPE, BY_K = TRANS.format(item="item"), TRANS.format(item="k")


def _trans(spark, d, item="item"):
    return sequences.transitions(view(spark, d, "access_log"), item=item)


@query(BY_K + "SELECT from_id, to_id, n AS count, epoch_us(last_seen) AS last_seen_us FROM trans", "access_log")
def seq01_transitions(spark, d):
    return _trans(spark, d, "k").withColumn("last_seen_us", F.unix_micros(F.col("last_seen").cast("timestamp"))).drop("last_seen")


@query(BY_TYPE + "SELECT from_id, to_id, n AS count, round(p, 9) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS r FROM prob) WHERE r <= 10", "access_log")
def seq02_access_patterns(spark, d):
    return sequences.access_patterns(_trans(spark, d)).select("from_id", "to_id", "count", F.round("probability", 9).alias("probability"))


@query(BY_TYPE + "SELECT from_id, to_id, n AS count, round(p, 9) AS probability, CAST(row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS r FROM prob) WHERE r <= 6 AND p >= 0.2 QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) <= 3", "access_log")
def seq03_predict_next(spark, d):
    return sequences.predict_next(_trans(spark, d), threshold=0.2).withColumn("probability", F.round("probability", 9))


@query(BY_K + "SELECT from_id, to_id, n AS count, round(p, 9) AS probability FROM prob WHERE n >= 2 ORDER BY n DESC, from_id, to_id LIMIT 50", "access_log")
def seq04_all_patterns(spark, d):
    return sequences.all_patterns(_trans(spark, d, "k")).select("from_id", "to_id", "count", F.round("probability", 9).alias("probability"))


@query(BY_K + "SELECT count(*) AS patterns, count(DISTINCT from_id) AS sources, CAST(coalesce(sum(n), 0) AS BIGINT) AS transitions FROM trans", "access_log")
def seq04_stats(spark, d):
    return sequences.sequence_stats(_trans(spark, d, "k"))


@query(BY_K + f"SELECT from_id, to_id, count FROM (SELECT from_id, to_id, CAST(CASE WHEN last_seen < {AS_OF} - INTERVAL 10 DAY THEN n // 2 ELSE n END AS BIGINT) AS count FROM trans) WHERE count > 0", "access_log")
def seq05_decay(spark, d):
    return sequences.decay(_trans(spark, d, "k"), as_of(), 10).select("from_id", "to_id", "count")


@query(BY_K + "SELECT id, 'predicted' AS promotion_source FROM memories WHERE NOT is_hot AND id IN (SELECT to_id FROM (SELECT to_id, p, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS r FROM prob) WHERE r <= 3 AND p >= 0.02)", "memories access_log")
def seq06_warm(spark, d):
    mem = view(spark, d, "memories")
    best = sequences.access_patterns(_trans(spark, d, "k"), 3).filter("probability >= 0.02")
    return sequences.warm(mem, best)


# Sources and stored rows


@query(f"SELECT log_id, project_id FROM output_log WHERE ts > {AS_OF} - INTERVAL 24 HOUR AND project_id = 'src3'", "output_log")
def src02_recent_outputs(spark, d):
    return memory.recent_outputs(view(spark, d, "output_log"), as_of(), 24, "src3").select("log_id", "project_id")


@query(
    """+u AS (SELECT conv_id, arg_max(text, turn) AS u FROM turns WHERE role = 'user' AND trim(text, ' ') <> '' GROUP BY 1),
a AS (SELECT conv_id, arg_max(text, turn) AS a FROM turns WHERE role = 'assistant' AND trim(text, ' ') <> '' GROUP BY 1)
SELECT conv_id, content FROM (SELECT conv_id, CASE WHEN u IS NULL THEN 'ASSISTANT: ' || a ELSE 'USER: ' || substr(u, 1, 500) || chr(10) || chr(10) || 'ASSISTANT: ' || a END AS content FROM a LEFT JOIN u USING (conv_id)) WHERE length(content) >= 20""",
    "turns",
)
def src03_last_turns(spark, d):
    return memory.last_turns(view(spark, d, "turns"))


CHUNKS = "chunks AS (SELECT id, chunk FROM (SELECT id, unnest(string_split(content, chr(10))) AS raw FROM memories), LATERAL (SELECT trim(raw, ' ') AS chunk) WHERE length(chunk) > 10 OR (length(chunk) >= 5 AND regexp_matches(chunk, '^[\\w.-]+\\s*[:=]\\s*\\S')))"


@query("+" + CHUNKS + " SELECT status, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY chunk ORDER BY id) = 1 THEN 'created' ELSE 'skipped' END AS status FROM chunks) GROUP BY 1", "memories")
def src05_seed_report(spark, d):
    files = view(spark, d, "memories").select(F.col("id").alias("path"), "content")
    return memory.seed(files, separator="\n")[1]


@query("+" + CHUNKS + " SELECT id, chunk FROM chunks", "memories")
def src07_chunk_plain(spark, d):
    return memory.chunk_plain(view(spark, d, "memories"), separator="\n").select("id", "chunk")


@query("SELECT CASE WHEN content IS NULL OR trim(content, ' ') = '' THEN 'blank' WHEN length(content) > 2000 THEN 'too_long' ELSE 'valid' END AS reason, count(*) AS n FROM memories GROUP BY 1", "memories")
def src09_validate(spark, d):
    return memory.validate(view(spark, d, "memories"), 2000).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def _redact_sql() -> str:
    out = "text"
    for pattern, mark in rules.REDACTIONS:
        out = f"regexp_replace({out}, {lit('(?i)' + pattern)}, {lit(mark.replace('$', chr(92)))}, 'g')"
    return out


@query(f"SELECT doc_id, sha256({_redact_sql()}) AS redacted_sha256, {_redact_sql()} <> text AS changed FROM documents")
def src10_redact(spark, d):
    df = spread(load(spark, d, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("redacted_sha256"), (tx.redact(F.col("text")) != F.col("text")).alias("changed"))


@query(" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS rule, count(*) AS n FROM documents WHERE regexp_matches(text, {lit('(?i)' + p)}) HAVING count(*) > 0" for i, p in enumerate(rules.SECRET_SIGNS)))
def src11_secret_rules(spark, d):
    return load(spark, d, "documents").select(F.explode(tx.secret_rules(F.col("text"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(c, '^https?://([^/]+)/(.+)') THEN CASE lower(regexp_extract(c, '^https?://([^/]+)/(.+)', 1)) WHEN 'github.com' THEN 'github' WHEN 'gitlab.com' THEN 'gitlab' WHEN 'bitbucket.org' THEN 'bitbucket' ELSE lower(regexp_extract(c, '^https?://([^/]+)/(.+)', 1)) END || '/' || regexp_extract(c, '^https?://([^/]+)/(.+)', 2) END AS repo
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', '') AS c FROM pages)"""
)
def src12_normalize_repo(spark, d):
    return load(spark, d, "pages").select("page_id", tx.normalize_repo(F.col("url")).alias("repo"))


@query("SELECT min(doc_id) AS id, sha256(content) AS content_hash, count(*) - 1 AS access_count FROM (SELECT doc_id, text AS content FROM documents) GROUP BY content", "")
def sto01_upsert_exact(spark, d):
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("project_id"), F.lit(0).alias("ts"))
    return memory.upsert_exact(None, rows, project_scoped=False).select("id", "content_hash", "access_count")


def _matches_sql(patterns: list[str]) -> str:
    """Number of matching patterns; word edges are spelt out, as DuckDB's know ASCII letters only."""
    edged = [p if not p.startswith(r"\b") else r"(?:^|[^\pL\pN_])" + p[2:] for p in patterns]
    edged = [p if not p.endswith(r"\b") else p[:-2] + r"(?:$|[^\pL\pN_])" for p in edged]
    return " + ".join(f"CAST(regexp_matches(content, {lit(p)}) AS INTEGER)" for p in edged)


def _importance_sql() -> str:
    n = "length(content)"
    code, entity = (_matches_sql(ps) for ps in (rules.CODE_SIGNS, rules.ENTITY_SIGNS))
    return f"((CASE WHEN {n} < 20 THEN 0.2 WHEN {n} < 100 THEN 0.5 WHEN {n} < 500 THEN 1.0 WHEN {n} < 2000 THEN 0.8 ELSE 0.6 END) * 0.3 + least(1.0, ({code}) * 0.25) * 0.4 + least(1.0, ({entity}) * 0.2) * 0.3)"


@query(f"SELECT id, CAST(round({_importance_sql()}, 3) AS DOUBLE) AS importance FROM memories", "memories")
def txt01_importance(spark, d):
    return spread(view(spark, d, "memories").select("id", "content")).select("id", F.round(tx.importance(F.col("content")), 3).alias("importance"))


@query(f"SELECT id, CAST({_matches_sql(rules.CODE_SIGNS)} AS INTEGER) AS code_matches, CAST({_matches_sql(rules.ENTITY_SIGNS)} AS INTEGER) AS entity_matches FROM memories", "memories")
def txt02_importance_breakdown(spark, d):
    _, code, _, entity, _ = tx.importance_parts(F.col("content"))
    return view(spark, d, "memories").select("id", code.alias("code_matches"), entity.alias("entity_matches"))


def _category_sql() -> str:
    ranked = ", ".join(f"{{'score': {' + '.join(f'CAST(regexp_matches(content, {lit('(?im)' + p)}) AS INTEGER)' for p in rules.CATEGORY_PATTERNS[c])}, 'priority': {-i}, 'name': {lit(c)}}}" for i, c in enumerate(rules.CATEGORY_PRIORITY))
    return f"SELECT id, best.name AS category FROM (SELECT id, list_max(list_filter([{ranked}], lambda x: x.score > 0)) AS best FROM memories)"


@query(_category_sql(), "memories")
def txt03_category(spark, d):
    return spread(view(spark, d, "memories").select("id", "content")).select("id", tx.category_at_hits(F.col("content")).alias("category"))


@query(
    f"SELECT id, {case('category', SCOPE, lit('stable'))} AS scope, CAST({case('category', rules.CATEGORY_TTL, '30.0')} AS DOUBLE) AS ttl_days, coalesce(category NOT IN ('command', 'snippet'), true) AS promotable, CAST(CASE WHEN category IS NULL THEN 0.5 WHEN category IN ('antipattern', 'landmine', 'constraint') THEN 0.3 ELSE 0.5 END AS DOUBLE) AS threshold, coalesce(category IN ('antipattern', 'landmine', 'constraint') AND trust_score >= 0.8, false) AS pin FROM memories",
    "memories",
)
def txt04_category_rules(spark, d):
    c = F.col("category")
    return view(spark, d, "memories").select("id", tx.scope(c).alias("scope"), tx.ttl_days(c).alias("ttl_days"), tx.promotable(c).alias("promotable"), F.round(tx.promotion_threshold(c), 6).alias("threshold"), tx.auto_pin(c, F.col("trust_score")).alias("pin"))


@query(
    r"""+t AS (SELECT id, pos, regexp_replace(regexp_replace(w, '^[`''"()\[\]{}<>,.;:!?]+', ''), '[`''"()\[\]{}<>,.;:!?]+$', '') AS token FROM (SELECT id, unnest(regexp_split_to_array(content, '\s+')) AS w, generate_subscripts(regexp_split_to_array(content, '\s+'), 1) AS pos FROM memories)),
f AS (SELECT id, token, min(pos) AS pos FROM t WHERE length(token) >= 6 AND regexp_matches(token, '[_./:\-0-9]|^.+[A-Z]') GROUP BY 1, 2)
SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM f) WHERE r <= 10 GROUP BY 1""",
    "memories",
)
def txt09_distinctive_tokens(spark, d):
    out = view(spark, d, "memories").select("id", F.array_join(tx.distinctive_tokens(F.col("content")), " ").alias("tokens"))
    return out.filter("tokens <> ''")


@query("SELECT id, memory_type FROM memories WHERE memory_type = 'pattern' AND (project_id = 'src3' OR project_id IS NULL) ORDER BY created_at DESC, id LIMIT 20 OFFSET 5", "memories")
def prj01_list(spark, d):
    return memory.list_memories(view(spark, d, "memories"), "pattern", "src3", 20, 5).select("id", "memory_type")


@query("SELECT count(*) AS with_global, count(*) FILTER (project_id = 'src3') AS strict FROM memories WHERE project_id = 'src3' OR project_id IS NULL", "memories")
def prj02_project_scope(spark, d):
    p = F.col("project_id")
    return view(spark, d, "memories").agg(F.sum(memory.in_project(p, "src3").cast("long")).alias("with_global"), F.sum(memory.in_project(p, "src3", False).cast("long")).alias("strict"))


@query("SELECT id, source FROM memories WHERE id IN (SELECT o_orderkey FROM orders)", "memories")
def prj03_by_id(spark, d):
    return memory.by_keys(view(spark, d, "memories"), load(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id").select("id", "source")


@query("SELECT id, access_count FROM memories WHERE id % 3 = 1 ORDER BY access_count DESC, created_at DESC, id LIMIT 50", "memories")
def prj04_by_tag(spark, d):
    mem = view(spark, d, "memories").withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))))
    return memory.by_tag(mem, "t1").select("id", "access_count")


@query("SELECT DISTINCT project_id, project_id AS label FROM memories WHERE project_id <> ''", "memories")
def prj05_projects(spark, d):
    mem = view(spark, d, "memories")
    return memory.projects(mem, mem.select(F.col("project_id").alias("project_path")))


@query(f"SELECT id, CASE WHEN last_used_at IS NULL THEN 'never verified' WHEN floor({days('last_used_at')}) >= {case('memory_type', rules.STALE_DAYS, '14')} THEN 'stale ' || CAST(CAST(floor({days('last_used_at')}) AS INTEGER) AS VARCHAR) || 'd' END AS staleness FROM memories", "memories")
def prj08_staleness(spark, d):
    return view(spark, d, "memories").select("id", tx.staleness(F.col("last_used_at"), F.col("memory_type"), as_of()).alias("staleness"))


@query("SELECT event_id, CASE WHEN similarity >= 0.85 THEN 'high' WHEN similarity >= 0.7 THEN 'medium' ELSE 'low' END AS label FROM retrievals", "retrievals")
def prj09_confidence(spark, d):
    return view(spark, d, "retrievals").select("event_id", tx.similarity_label(F.col("similarity")).alias("label"))


@query("SELECT CASE WHEN source = 'mined' THEN 0.7 ELSE 1.0 END::DOUBLE AS trust_score, source, count(*) AS n FROM memories GROUP BY 1, 2", "memories")
def sto03_admit(spark, d):
    return memory.admit(view(spark, d, "memories").select("id", "content", "source", "created_at")).groupBy("trust_score", "source").agg(F.count("*").alias("n"))


@query("SELECT 'memories' AS part, count(*) AS n FROM memories WHERE id % 10 <> 3 UNION ALL SELECT 'audit', count(*) FROM memories WHERE id % 10 = 3 UNION ALL SELECT 'retrievals', count(*) FROM retrievals WHERE memory_id NOT IN (SELECT id FROM memories WHERE id % 10 = 3)", "memories retrievals")
def sto04_forget(spark, d):
    mem = view(spark, d, "memories")
    out = memory.forget(mem, mem.filter("id % 10 = 3").select("id"), {"retrievals": view(spark, d, "retrievals")}, as_of())
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT target_id, operation FROM (SELECT id AS target_id, 'delete_memory' AS operation, created_at FROM memories WHERE created_at >= {AS_OF} - INTERVAL 30 DAY) ORDER BY created_at DESC, target_id DESC LIMIT 50", "memories")
def sto05_audit(spark, d):
    audit = view(spark, d, "memories").select(F.col("id").alias("target_id"), F.lit("delete_memory").alias("operation"), "created_at")
    return memory.audit_history(memory.purge(audit, "created_at", as_of(), 30), operation="delete_memory").select("target_id", "operation")


# Scores

SCORED = {
    "sco01_recency": (lambda: scores.recency(F.col("last_accessed_at"), as_of()), recency("last_accessed_at", 30.0)),
    "sco02_trust_decayed": (lambda: scores.trust_decayed(F.col("trust_score"), F.col("created_at"), F.col("last_accessed_at"), F.col("memory_type"), F.col("access_count"), as_of()), trust_now()),
    "sco03_hot_score": (lambda: scores.hot_score(F.col("access_count"), F.col("last_accessed_at"), as_of()), hot_score()),
    "sco04_salience": (lambda: sum(scores.salience_parts(F.col("importance_score"), F.col("trust_score"), F.col("access_count"), F.col("last_accessed_at"), as_of()).values(), F.lit(0.0)), salience()),
    "sco05_helpfulness": (lambda: scores.helpfulness(F.col("used_count"), F.col("retrieved_count")), "((used_count + 1) / (retrieved_count + 4))"),
    "sco06_helpfulness_decayed": (lambda: scores.helpfulness_decayed(F.col("utility_score"), F.col("last_used_at"), F.col("category"), as_of()), f"(CASE WHEN last_used_at IS NULL THEN utility_score * 0.8 ELSE utility_score * pow(0.95, {days('last_used_at')} / {case('category', rules.CATEGORY_TTL, '30.0')}) END)"),
}
for _name, (_column, _sql) in SCORED.items():

    def _run(spark, d, column=_column):
        return view(spark, d, "memories").select("id", F.round(column(), 6).alias("score"))

    _run.__name__ = _name
    query(f"SELECT id, CAST(round({_sql}, 6) AS DOUBLE) AS score FROM memories", "memories")(_run)

DELTA = f"(CASE WHEN {case('reason', rules.TRUST_CHANGE, '0.0')} > 0 AND similarity IS NOT NULL THEN {case('reason', rules.TRUST_CHANGE, '0.0')} * (0.5 + 0.5 * similarity) ELSE {case('reason', rules.TRUST_CHANGE, '0.0')} END)"


@query(
    f"""+s AS (SELECT memory_id, list(CAST({DELTA} AS DOUBLE) ORDER BY seq) AS steps FROM trust_events GROUP BY 1)
SELECT memory_id, round(list_reduce(list_prepend(trust_score, steps), lambda a, x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, a + x))), 6) AS trust, CAST(len(steps) AS INTEGER) AS n_steps FROM s JOIN memories ON id = memory_id""",
    "memories trust_events",
)
def sco07_replay_trust(spark, d):
    out = hotset.last_trust(view(spark, d, "memories"), view(spark, d, "trust_events"))
    return out.select("memory_id", F.round("trust", 6).alias("trust"), "n_steps")


@query(f"SELECT memory_id, seq, CAST(round({DELTA}, 9) AS DOUBLE) AS delta FROM trust_events QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, seq DESC) <= 5", "trust_events")
def sco08_trust_history(spark, d):
    return hotset.trust_history(view(spark, d, "trust_events"), 5).select("memory_id", "seq", F.round("delta", 9).alias("delta"))


@query("SELECT event_id, CAST(round(0.03 * (0.5 + 0.5 * similarity), 9) AS DOUBLE) AS delta FROM retrievals WHERE similarity >= 0.9", "retrievals")
def sco09_strengthen(spark, d):
    return hotset.strengthen(view(spark, d, "retrievals")).select("event_id", F.round("delta", 9).alias("delta"))


@query("SELECT id AS memory_id, 'low_utility' AS reason FROM memories WHERE retrieved_count >= 5 AND used_count = 0", "memories")
def sco10_penalize(spark, d):
    return hotset.penalize(view(spark, d, "memories")).select("memory_id", "reason")


@query(f"SELECT id FROM memories WHERE source = 'mined' AND NOT is_pinned AND retrieved_count = 0 AND used_count = 0 AND created_at < {AS_OF} - INTERVAL 30 DAY AND (is_hot OR utility_score > 0)", "memories")
def sco11_decay_unused(spark, d):
    return hotset.decay_unused(view(spark, d, "memories"), as_of()).filter("decayed").select("id")


# Hot set


@query(
    f"""SELECT reason, decision, pin, count(*) AS n FROM (SELECT reason, CASE reason WHEN 'auto_threshold' THEN 'promote' WHEN 'already_hot' THEN 'none' ELSE 'reject' END AS decision, reason = 'auto_threshold' AND coalesce(category IN ('antipattern', 'landmine', 'constraint') AND trust_score >= 0.8, false) AS pin
FROM (SELECT *, CASE WHEN is_hot THEN 'already_hot' WHEN category IN ('command', 'snippet') THEN 'category_ineligible' WHEN NOT (round({salience()}, 3) >= (CASE WHEN category IN ('antipattern', 'landmine', 'constraint') THEN 0.3 ELSE 0.5 END) OR access_count >= 3) THEN 'threshold_not_met' WHEN retrieved_count >= 3 AND (used_count + 1) / (retrieved_count + 4) < 0.2 THEN 'low_helpfulness' ELSE 'auto_threshold' END AS reason FROM memories)) GROUP BY ALL""",
    "memories",
)
def hot01_promotion_decisions(spark, d):
    return hotset.promotion_decisions(view(spark, d, "memories"), as_of()).groupBy("reason", "decision", "pin").agg(F.count("*").alias("n"))


@query(f"SELECT id, CAST(round({hot_score()}, 6) AS DOUBLE) AS hot_score, is_pinned OR row_number() OVER (ORDER BY is_pinned DESC, {hot_score()} DESC, id) <= 10 AS kept FROM memories WHERE is_hot", "memories")
def hot02_select(spark, d):
    return hotset.select_hot(view(spark, d, "memories"), as_of()).select("id", F.round("hot_score", 6).alias("hot_score"), "kept")


@query(f"SELECT id, CAST(round({trust_now()}, 6) AS DOUBLE) AS trust_now, CAST(round(CASE WHEN access_count > 0 THEN used_count / access_count ELSE 0 END, 6) AS DOUBLE) AS use_ratio FROM memories WHERE is_hot", "memories")
def hot03_order(spark, d):
    return hotset.order_hot(view(spark, d, "memories"), as_of()).select("id", F.round("trust_now", 6).alias("trust_now"), F.round("use_ratio", 6).alias("use_ratio"))


FACTOR = case("category", {c: rules.SCOPE_FACTOR[s] for c, s in SCOPE.items()}, "1.0")


@query(f"SELECT id, CAST(floor({days('coalesce(last_accessed_at, created_at)')}) AS BIGINT) AS idle_days FROM memories WHERE is_hot AND NOT is_pinned AND floor({days('coalesce(last_accessed_at, created_at)')}) >= floor(14 * {FACTOR})", "memories")
def hot04_stale(spark, d):
    return hotset.stale_hot(view(spark, d, "memories"), as_of()).select("id", "idle_days")


@query("SELECT id, CASE id % 6 WHEN 1 THEN true WHEN 2 THEN false ELSE is_hot END AS is_hot, CASE WHEN id % 6 = 0 THEN is_hot WHEN id % 6 IN (2, 3) THEN false ELSE is_pinned END AS is_pinned FROM memories", "memories")
def hot05_actions(spark, d):
    mem = view(spark, d, "memories")
    actions = mem.filter("id % 6 < 4").select("id", F.lit(1).alias("seq"), F.element_at(F.array(*map(F.lit, ["pin", "promote", "demote", "unpin"])), (F.col("id") % 6 + 1).cast("int")).alias("action"))
    old = actions.select("id", F.lit(0).alias("seq"), F.lit("demote").alias("action"))
    return hotset.apply_actions(mem, actions.unionByName(old)).select("id", "is_hot", "is_pinned")


@query(
    f"""+r AS (SELECT memory_id AS id, row_number() OVER (ORDER BY max(created_at) DESC, memory_id) AS ord FROM retrievals WHERE was_used GROUP BY 1 QUALIFY ord <= 5),
p AS (SELECT id, CAST(1 AS INTEGER) AS priority, CAST(ord AS DOUBLE) AS ord FROM r UNION ALL SELECT id, 3, -CAST(round({salience()}, 3) AS DOUBLE) FROM memories WHERE is_hot)
SELECT id, CAST(m.priority AS INTEGER) AS priority, round(m.ord, 3) AS ord FROM (SELECT id, min({{'priority': priority, 'ord': ord}}) AS m FROM p GROUP BY 1) ORDER BY m.priority, m.ord, id LIMIT 10""",
    "memories retrievals",
)
def hot06_context(spark, d):
    from pyspark.sql import Window

    recent = feedback.recent_recalls(view(spark, d, "retrievals"))
    recent = recent.select(F.col("memory_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("used_at"), "memory_id")).alias("ord"))  # five rows
    return hotset.hot_context(view(spark, d, "memories"), recent, recent.limit(0), as_of()).withColumn("ord", F.round("ord", 3))


KEEP = case("memory_type", rules.RETENTION_DAYS, "0")


@query(f"SELECT memory_type, count(*) AS n FROM memories WHERE {KEEP} > 0 AND NOT is_hot AND {days('coalesce(last_accessed_at, created_at)')} > {KEEP} AND {days('created_at')} > {KEEP} GROUP BY 1", "memories")
def hot07_retention(spark, d):
    return hotset.retention(view(spark, d, "memories"), as_of()).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("SELECT session_id AS query_id, id FROM memories WHERE NOT is_hot AND access_count >= 3 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id) <= 2", "memories")
def hot08_suggest(spark, d):
    return hotset.suggest(view(spark, d, "memories").withColumns({"query_id": F.col("session_id"), "rank": F.col("id")})).select("query_id", "id")


@query(f"SELECT count(*) AS n_hot, count(*) FILTER (is_pinned) AS n_pinned, CAST(round(avg({hot_score()}), 6) AS DOUBLE) AS avg_hot_score, arg_max(id, access_count * 1000000000 - id) AS most_accessed, arg_min(id, access_count * 1000000000 + id) FILTER (NOT is_pinned) AS least_accessed FROM memories WHERE is_hot", "memories")
def hot09_metrics(spark, d):
    return hotset.hot_metrics(view(spark, d, "memories"), as_of())


# Feedback


@query("SELECT event_id, was_used OR (event_type_ = 'view' AND memory_id < 10) AS was_used FROM (SELECT *, split_part(query_key, '-', 1) AS event_type_ FROM retrievals)", "retrievals")
def ret02_mark_used(spark, d):
    events = view(spark, d, "retrievals")
    marks = events.filter("query_key LIKE 'view-%' AND memory_id < 10").select("memory_id", "query_key")
    return feedback.mark_used(events, marks).select("event_id", "was_used")


@query("SELECT memory_id, count(*) AS retrieved_count, count(*) FILTER (was_used) AS used_count, CAST(round((count(*) FILTER (was_used) + 1) / (count(*) + 4), 6) AS DOUBLE) AS utility_score FROM retrievals GROUP BY 1", "retrievals")
def ret01_usage_counts(spark, d):
    return feedback.usage_counts(view(spark, d, "retrievals")).select("memory_id", "retrieved_count", "used_count", F.round("utility_score", 6).alias("utility_score"))


STATS = "count(*) AS total, count(*) FILTER (was_used) AS used, round(avg(CAST(was_used AS DOUBLE)), 6) AS use_rate, round(avg(similarity), 6) AS avg_similarity, round(avg(similarity) FILTER (was_used), 6) AS avg_similarity_used, count(DISTINCT memory_id) AS n_memories, count(DISTINCT query_key) AS n_queries"


@query(f"SELECT {STATS} FROM retrievals WHERE created_at > {AS_OF} - INTERVAL 14 DAY", "retrievals")
def ret03_retrieval_stats(spark, d):
    return feedback.retrieval_stats(view(spark, d, "retrievals"), as_of(), 14)


@query(f"SELECT query_key, {STATS} FROM retrievals WHERE created_at > {AS_OF} - INTERVAL 14 DAY GROUP BY 1", "retrievals")
def ret03_by_query(spark, d):
    return feedback.retrieval_stats(view(spark, d, "retrievals"), as_of(), 14, "query_key")


@query("SELECT memory_id, epoch_us(max(created_at)) AS used_us FROM retrievals WHERE was_used GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "retrievals")
def ret04_recent_recalls(spark, d):
    return feedback.recent_recalls(view(spark, d, "retrievals")).select("memory_id", F.unix_micros(F.col("used_at").cast("timestamp")).alias("used_us"))


WEEK = f"injected_at > {AS_OF} - INTERVAL 7 DAY"


@query(f"SELECT id, coalesce(n, 0) AS n, n IS NOT NULL AS was_injected FROM memories LEFT JOIN (SELECT memory_id, count(*) AS n FROM injections WHERE {WEEK} GROUP BY 1) ON id = memory_id", "memories injections")
def inj01_was_injected(spark, d):
    return feedback.was_injected(view(spark, d, "memories"), view(spark, d, "injections"), as_of())


@query(f"SELECT i.memory_id, i.session_id, substr(content, 1, 100) AS preview FROM (SELECT * FROM injections WHERE {WEEK} AND resource = 'view' ORDER BY injected_at DESC, memory_id, session_id LIMIT 50) i LEFT JOIN memories ON id = memory_id", "memories injections")
def inj01_recent(spark, d):
    return feedback.recent_injections(view(spark, d, "injections"), view(spark, d, "memories"), as_of(), resource="view").select("memory_id", "session_id", "preview")


@query(f"SELECT resource, count(*) AS total, count(DISTINCT memory_id) AS n_memories, count(*) FILTER (injected_at >= date_trunc('day', {AS_OF})) AS today FROM injections WHERE {WEEK} GROUP BY 1", "injections")
def inj02_stats(spark, d):
    return feedback.injection_stats(view(spark, d, "injections"), as_of())


VALUE = f"v AS (SELECT id, n, n >= 3 AND used_count > 0 AS high_value, n >= 5 AND used_count = 0 AS low_utility, NOT is_hot AND n >= 5 AND utility_score >= 0.3 AS candidate FROM memories JOIN (SELECT memory_id, count(*) AS n FROM injections WHERE {WEEK} GROUP BY 1) ON id = memory_id)"


@query("+" + VALUE + " SELECT * FROM v", "memories injections")
def inj03_value(spark, d):
    return feedback.injection_value(view(spark, d, "injections"), view(spark, d, "memories"), as_of()).select("id", "n", "high_value", "low_utility", "candidate")


@query(f"SELECT a.memory_id AS a, b.memory_id AS b, count(*) AS n FROM injections a JOIN injections b ON a.resource = b.resource AND a.memory_id < b.memory_id AND abs(epoch_us(a.injected_at) - epoch_us(b.injected_at)) < 3600000000 WHERE a.injected_at > {AS_OF} - INTERVAL 7 DAY AND b.injected_at > {AS_OF} - INTERVAL 7 DAY GROUP BY 1, 2 HAVING count(*) >= 2", "injections")
def inj04_co_occurrence(spark, d):
    return feedback.co_occurrence(view(spark, d, "injections"), as_of(), 3600.0, 2)


@query("+" + VALUE + " SELECT id, 'promote' AS action, 'feedback' AS source FROM v WHERE candidate UNION ALL SELECT id, 'warn', NULL FROM v WHERE low_utility", "memories injections")
def inj06_actions(spark, d):
    return feedback.feedback_actions(feedback.injection_value(view(spark, d, "injections"), view(spark, d, "memories"), as_of()))


@query("+c AS (SELECT memory_id, count(DISTINCT session_id) AS n_sessions, string_agg(DISTINCT session_id::VARCHAR, ',' ORDER BY session_id::VARCHAR) AS s FROM injections GROUP BY 1) SELECT id, n_sessions, access_count FROM c JOIN memories ON id = memory_id WHERE n_sessions >= 2 ORDER BY n_sessions DESC, access_count DESC, id LIMIT 50", "memories injections")
def inj07_cross_session(spark, d):
    return feedback.cross_session(view(spark, d, "injections"), view(spark, d, "memories")).select("id", "n_sessions", "access_count")


# Graph


@query("SELECT from_id, to_id, relation_type FROM edges WHERE from_id % 2 = 1 AND from_id IN (SELECT id FROM memories) AND to_id IN (SELECT id FROM memories)", "edges memories")
def gra01_link(spark, d):
    edges = view(spark, d, "edges")
    return graph.link(edges.filter("from_id % 2 = 0"), edges, view(spark, d, "memories"), rules.RELATIONS)


@query("SELECT relation_type, count(*) AS n FROM edges WHERE NOT (from_id % 10 = 0 AND relation_type = 'mentions') AND from_id % 10 <> 1 GROUP BY 1", "edges")
def gra02_unlink(spark, d):
    edges = view(spark, d, "edges")
    gone = edges.filter("from_id % 10 = 0 AND relation_type = 'mentions'").unionByName(edges.filter("from_id % 10 = 1").withColumn("relation_type", F.lit(None).cast("string")))
    return graph.unlink(edges, gone).groupBy("relation_type").agg(F.count("*").alias("n"))


@query("SELECT from_id AS id, to_id AS other_id, relation_type, 'outgoing' AS direction FROM edges WHERE from_id % 20 = 0 UNION ALL SELECT to_id, from_id, relation_type, 'incoming' FROM edges WHERE to_id % 20 = 0", "edges")
def gra03_related(spark, d):
    edges = view(spark, d, "edges")
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).filter("id % 20 = 0")
    return graph.related(edges, ids)


@query("SELECT relation_type, count(*) AS n, CAST(NULL AS BIGINT) AS n_nodes FROM edges GROUP BY 1 UNION ALL SELECT NULL, count(*), (SELECT count(DISTINCT i) FROM (SELECT from_id AS i FROM edges UNION ALL SELECT to_id FROM edges)) FROM edges", "edges")
def gra04_edge_stats(spark, d):
    return graph.edge_stats(view(spark, d, "edges"))


@query("SELECT from_id, to_id, substr(a.content, 1, 100) AS from_preview, substr(b.content, 1, 100) AS to_preview FROM edges JOIN memories a ON a.id = from_id JOIN memories b ON b.id = to_id WHERE relation_type = 'contradicts'", "edges memories")
def gra07_contradictions(spark, d):
    return graph.list_contradictions(view(spark, d, "edges"), view(spark, d, "memories"))


@query("SELECT id, substr(content, 1, 40) AS label FROM memories WHERE id IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges) ORDER BY id LIMIT 100", "edges memories")
def gra10_nodes(spark, d):
    return graph.graph_nodes(view(spark, d, "edges"), view(spark, d, "memories"))


# Sessions and reports

ROLL = "roll AS (SELECT session_id, min(ts) AS started_at, max(ts) AS last_activity, CAST(sum(m) AS BIGINT) AS memory_count, CAST(sum(l) AS BIGINT) AS log_count FROM (SELECT session_id, created_at AS ts, 1 AS m, 0 AS l FROM memories UNION ALL SELECT session_id, ts, 0, 1 FROM output_log) GROUP BY 1)"


def _rolled(spark, d):
    return sessions.sessions(view(spark, d, "memories"), view(spark, d, "output_log"))


@query("+" + ROLL + " SELECT session_id, epoch_us(started_at) AS started_us, epoch_us(last_activity) AS last_us, memory_count, log_count FROM roll", "memories output_log")
def ses01_sessions(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _rolled(spark, d).select("session_id", us("started_at").alias("started_us"), us("last_activity").alias("last_us"), "memory_count", "log_count")


@query("+" + ROLL + " SELECT session_id, memory_count FROM roll ORDER BY last_activity DESC, session_id LIMIT 5", "memories output_log")
def ses02_recent(spark, d):
    return sessions.recent_sessions(_rolled(spark, d), limit=5).select("session_id", "memory_count")


@query("SELECT session_id, id, 's' || (id % 3)::VARCHAR || ',t' || (id % 2)::VARCHAR AS tags FROM memories QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) <= 10", "memories")
def ses03_items(spark, d):
    mem = view(spark, d, "memories")
    tags = mem.select(F.col("id").alias("memory_id"), F.explode(F.array(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))).alias("tag"))
    return sessions.session_items(mem, tags, 10).select("session_id", "id", "tags")


@query("+" + ROLL + " SELECT roll.session_id, log_count, n_items, n_hot FROM roll LEFT JOIN (SELECT session_id, count(*) AS n_items, count(*) FILTER (is_hot) AS n_hot FROM memories GROUP BY 1) c ON c.session_id = roll.session_id", "memories output_log")
def ses04_overview(spark, d):
    return sessions.session_overview(_rolled(spark, d), view(spark, d, "memories")).select("session_id", "log_count", "n_items", "n_hot")


THEME = "CASE WHEN category IN ('decision', 'architecture', 'constraint') THEN 'decisions' WHEN category IN ('lesson', 'antipattern', 'landmine', 'observation') THEN 'insights' WHEN category IN ('todo', 'bug', 'workflow') THEN 'actions' ELSE 'context' END"


@query(f"SELECT session_id, {THEME} AS theme, id, CAST(row_number() OVER (PARTITION BY session_id, {THEME} ORDER BY importance_score DESC, id) AS INTEGER) AS rank FROM memories QUALIFY rank <= 20", "memories")
def ses05_summary(spark, d):
    return sessions.summarize_sessions(view(spark, d, "memories")).select("session_id", "theme", "id", "rank")


@query(f"SELECT session_id, id, CAST(round({salience()}, 3) AS DOUBLE) AS salience FROM memories WHERE memory_type = 'episodic' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round({salience()}, 3) DESC, id) <= 3 AND round({salience()}, 3) >= 0.6", "memories")
def ses06_end(spark, d):
    return sessions.end_sessions(view(spark, d, "memories"), as_of()).select("session_id", "id", "salience")


@query("SELECT memory_type, source, c AS category, count(*) AS n, count(*) FILTER (is_hot) AS n_hot, CAST(sum(access_count) AS BIGINT) AS accesses, CAST(round(avg(trust_score), 6) AS DOUBLE) AS avg_trust FROM (SELECT *, coalesce(category, 'uncategorized') AS c FROM memories) GROUP BY GROUPING SETS ((), (memory_type), (source), (c))", "memories")
def agg01_stats(spark, d):
    return reports.stats(view(spark, d, "memories"), 6)


@query(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (is_hot) AS n_hot FROM memories WHERE created_at > {AS_OF} - INTERVAL 30 DAY GROUP BY 1", "memories")
def agg02_daily(spark, d):
    return reports.daily(view(spark, d, "memories"), "created_at", as_of(), 30, "is_hot")


@query("+r AS (SELECT count(DISTINCT query_key) AS a, count(*) AS b, count(*) FILTER (was_used) AS c FROM retrievals), m AS (SELECT count(*) FILTER (is_hot) AS a, count(*) FILTER (is_pinned) AS b, count(*) FILTER (source = 'mined') AS c FROM memories) SELECT 'recall_total' AS metric, a AS value FROM r UNION ALL SELECT 'recall_returned', b FROM r UNION ALL SELECT 'recall_used', c FROM r UNION ALL SELECT 'hot_size', a FROM m UNION ALL SELECT 'hot_pinned', b FROM m UNION ALL SELECT 'store_mined', c FROM m", "memories retrievals")
def agg03_metrics(spark, d):
    return reports.op_metrics(view(spark, d, "retrievals"), view(spark, d, "memories"))


@query(f"SELECT session_id, count(*) AS n FROM output_log WHERE ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1", "output_log")
def agg04_purge(spark, d):
    return memory.purge(view(spark, d, "output_log"), "ts", as_of(), 7).groupBy("session_id").agg(F.count("*").alias("n"))


RUNS_AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"


@query(f"SELECT CASE WHEN (SELECT count(*) FILTER (failed) FROM (SELECT failed FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 3)) = 3 THEN 'red' WHEN max(started_at) FILTER (NOT failed) IS NULL OR max(started_at) FILTER (NOT failed) < {RUNS_AS_OF} - INTERVAL 7 DAY THEN 'amber' ELSE 'green' END AS state, count(*) FILTER (NOT failed AND started_at > {RUNS_AS_OF} - INTERVAL 7 DAY) AS recent_successes, CAST(coalesce(sum(n_patterns) FILTER (NOT failed AND started_at > {RUNS_AS_OF} - INTERVAL 7 DAY), 0) AS BIGINT) AS recent_patterns FROM runs", "runs")
def min09_loop_health(spark, d):
    return reports.loop_health(view(spark, d, "runs"), as_of(RUNS_AS_OF))


# Patterns

SECRET = lit("(?i)" + "|".join(rules.SECRET_SIGNS))
MINED = f"""mined AS (SELECT pattern, sha256(pattern) AS pattern_hash, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, 0.5 AS confidence, min({{'t': ts, 'i': log_id}}).i AS log_id
FROM (SELECT log_id, ts, unnest(string_split(content, chr(10))) AS pattern FROM output_log) WHERE length(pattern) >= 30 AND NOT regexp_matches(pattern, {SECRET}) GROUP BY 1)"""
SCORE = f"(least(n / 10, 1.0) * pow(0.5, floor({days('last_seen')}) / 7) * 0.5)"


def _mined(spark, d):
    return extract.aggregate_patterns(extract.line_patterns(view(spark, d, "output_log")))


@query("+" + MINED + " SELECT pattern_hash, n AS count, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, log_id FROM mined", "output_log")
def min01_aggregate(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _mined(spark, d).select("pattern_hash", "count", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "log_id")


@query("+" + MINED + f" SELECT pattern_hash, CAST(round({SCORE}, 6) AS DOUBLE) AS score FROM mined", "output_log")
def min02_score(spark, d):
    return extract.pattern_score(_mined(spark, d), as_of()).select("pattern_hash", F.round("score", 6).alias("score"))


@query("+" + MINED + " SELECT pattern_hash, n AS count FROM mined WHERE n >= 3", "output_log")
def min03_candidates(spark, d):
    return extract.candidates(extract.pattern_score(_mined(spark, d), as_of())).select("pattern_hash", "count")


@query("+" + MINED + f" SELECT CASE WHEN n >= 5 THEN 'approved' WHEN last_seen < {AS_OF} - INTERVAL 5 DAY THEN 'rejected' ELSE 'pending' END AS status, count(*) AS n FROM mined GROUP BY 1", "output_log")
def min04_status(spark, d):
    mined = _mined(spark, d)
    marked = extract.set_status(mined, mined.filter("count >= 5").select("pattern_hash", F.lit("approved").alias("new_status")))
    return extract.expire(marked, as_of(), 5).groupBy("status").agg(F.count("*").alias("n"))


@query("+" + MINED + " SELECT sha256(pattern) AS content_sha256, 'pattern' AS memory_type, log_id AS source_log_id FROM mined", "output_log")
def min05_admit(spark, d):
    return extract.admit_patterns(_mined(spark, d)).select(F.sha2("content", 256).alias("content_sha256"), "memory_type", "source_log_id")


@query("+" + MINED + " SELECT id FROM memories WHERE sha256(content) IN (SELECT pattern_hash FROM mined WHERE n >= 3)", "output_log memories")
def min06_promote(spark, d):
    return extract.promote_frequent(_mined(spark, d), view(spark, d, "memories"))


@query("SELECT DISTINCT a.id AS from_id, b.id AS to_id, CASE WHEN a.id % 3 = 0 THEN 'mentions' ELSE 'depends_on' END AS relation_type FROM memories a JOIN memories b ON a.id // 10 = b.id // 10 WHERE b.id % 3 <> 0 AND a.id <> b.id AND (a.id % 3 = 0 OR (a.id % 3 = 1 AND b.id % 3 = 2))", "memories")
def min07_entity_links(spark, d):
    mem = view(spark, d, "memories").select("id", F.floor(F.col("id") / 10).cast("long").alias("source_log_id"), F.element_at(F.array(F.lit("fact"), F.lit("entity_decision"), F.lit("entity_technology")), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    return extract.entity_links(mem, view(spark, d, "edges").limit(0))


@query("+" + MINED + " SELECT 'pending' AS status, count(*) AS n, count(*) FILTER (n >= 3) AS n_frequent, CAST(sum(n) AS BIGINT) AS occurrences FROM mined", "output_log")
def min10_stats(spark, d):
    return extract.mining_stats(_mined(spark, d))


SAMPLE = "\nimport numpy.linalg\nThis project uses Spark and Parquet\n$ git status --short\nWe decided to keep one table per day because scans are cheap\nGET /v1/items\n"
MINING_SAMPLE = "\nThis project uses Spark and Parquet for every table\nOur PostgreSQL database is slow. We decided to keep one table per day because scans are cheap\n"


def _logs(content: str) -> str:
    return f"notes AS MATERIALIZED (SELECT log_id, {content} AS content, ts FROM output_log), "


@query("+" + _logs(f"content || {lit(SAMPLE)} || log_id") + extraction.FOUND + extraction.BY_KIND, "output_log")
def ext15_extract_all(spark, d):
    """All extractors over the logs, each with a marked sentence appended, as the tables hold no such text."""
    logs = spread(view(spark, d, "output_log")).withColumn("content", F.concat("content", F.lit(SAMPLE), "log_id"))
    return extract.extract_all(logs).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("log_id").alias("n_logs"))


@query("+" + _category_sql().replace("SELECT id, best.name", "cats AS (SELECT id, best.name").replace("FROM memories)", "FROM memories))") + " SELECT (m.category IS DISTINCT FROM c.category) AS changed, count(*) AS n FROM memories m JOIN cats c USING (id) GROUP BY 1", "memories")
def txt07_recategorize(spark, d):
    return jobs.recategorize(spread(view(spark, d, "memories").select("id", "category", "content")), every=True)[1]


@query("+" + _logs(f"content || {lit(MINING_SAMPLE)}") + extraction.RUN + extraction.COUNTERS, "output_log")
def min08_run_mining(spark, d):
    """All extractors over the whole log, with marked sentences appended as in ext15."""
    logs = spread(view(spark, d, "output_log")).withColumn("content", F.concat("content", F.lit(MINING_SAMPLE)))
    return jobs.run_mining(logs, None, as_of())["run"]


_IDLE = "floor({})".format(days("coalesce(last_accessed_at, created_at)"))
_CLEANUP = BY_K.rstrip() + ", " + MINED + f""",
stale AS (SELECT id FROM memories WHERE is_hot AND NOT is_pinned AND {_IDLE} >= floor(14 * {FACTOR})),
demoted AS (SELECT * REPLACE (is_hot AND id NOT IN (SELECT id FROM stale) AS is_hot) FROM memories),
retired AS (SELECT id FROM demoted WHERE {KEEP} > 0 AND NOT is_hot AND {days('coalesce(last_accessed_at, created_at)')} > {KEEP} AND {days('created_at')} > {KEEP}),
kept AS (SELECT * FROM demoted WHERE id NOT IN (SELECT id FROM retired))
SELECT 'demoted' AS step, count(*) AS n FROM stale
UNION ALL SELECT 'expired_patterns', count(*) FROM mined WHERE last_seen < {AS_OF} - INTERVAL 30 DAY
UNION ALL SELECT 'kept_logs', count(*) FROM output_log WHERE ts >= {AS_OF} - INTERVAL 7 DAY
UNION ALL SELECT 'retired', count(*) FROM retired
UNION ALL SELECT 'kept_transitions', count(*) FROM trans WHERE last_seen >= {AS_OF} - INTERVAL 30 DAY OR n >= 2
UNION ALL SELECT 'kept_injections', count(*) FROM injections WHERE injected_at >= {AS_OF} - INTERVAL 7 DAY
UNION ALL SELECT 'penalties', count(*) FROM kept WHERE retrieved_count >= 5 AND used_count = 0
UNION ALL SELECT 'actions', count(*) FROM (WITH memories AS (SELECT * FROM kept), {VALUE} SELECT 1 FROM v WHERE candidate UNION ALL SELECT 1 FROM v WHERE low_utility)
UNION ALL SELECT 'unused', count(*) FROM kept WHERE source = 'mined' AND NOT is_pinned AND retrieved_count = 0 AND used_count = 0 AND created_at < {AS_OF} - INTERVAL 30 DAY AND (is_hot OR utility_score > 0)"""


@query(_CLEANUP, "access_log output_log memories injections")
def hot10_full_cleanup(spark, d):
    trans = sequences.transitions(view(spark, d, "access_log"), item="k")
    return jobs.full_cleanup(view(spark, d, "memories"), _mined(spark, d), view(spark, d, "output_log"), trans, view(spark, d, "injections"), as_of())["report"]

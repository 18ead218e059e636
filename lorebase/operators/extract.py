"""Patterns mined from logs: extractors, their union, aggregation, scoring and admission.

An extractor is a list of expressions; their groups are arrays of what each match holds, zipped by match. One extractor
takes them by regexp_extract_all; all together take them from one pass over each text that tries an expression
only around the literals which it needs (lorebase.functions.literals). logs: log_id, content, ts, project_id, session_id.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lorebase.functions import literals, rules
from lorebase.functions import text as tx
from lorebase.operators.graph import link

_TECH = "|".join(sorted((t.replace("+", r"\+") for ts in rules.TECHNOLOGIES.values() for t in ts), key=lambda t: (-len(t), t)))
_PACKAGE = r"[\w\-]+(?:\[[\w,]+\])?\s*[~=<>!]+\s*[\d.]+"

# Expressions of each kind, with the number of their groups (0: the whole match).
FACTS = [r"[Tt]his project uses\s+[\w\s,]+", r"[Ww]e use\s+[\w\s,]+(?:for|to)\s+[\w\s,]+", r"[Tt]he (?:API|database|server|client) (?:is|uses|runs)\s+[\w\s,]+", r"[Aa]uthentication (?:uses|is handled by)\s+[\w\s,]+", r"[Tt]ests (?:use|are run with)\s+[\w\s,]+"]
DECISIONS = [
    (r"(?:decided|chose|went with|settled on|opted for)\s+(.{10,150})", 1),
    (r"(?:instead of|rather than)\s+(\w+).{0,30}?(?:use|chose|using)\s+(.{5,100})", 2),
    (r"(?:trade-?off|compromise)[:.]?\s*(.{10,200})", 1),
    (r"(?:we|I)\s+(?:will|should|need to)\s+(?:use|implement|build)\s+(.{10,100})", 1),
]
ARCHITECTURE = [
    (r"(?:the\s+)?(\w+(?:\s+\w+)?)\s+(?:uses|runs on|is built with|is powered by)\s+(.{5,100})", 2),
    (r"(?:the\s+)?(\w+(?:\s+\w+)?)\s+(?:handles|manages|is responsible for)\s+(.{5,100})", 2),
    (r"(\w+)\s+(?:communicates|connects|talks)\s+(?:with|to|via)\s+(\w+(?:\s+\w+)?)", 2),
    (r"(?:uses?|following|implementing)\s+(?:a\s+)?(\w+)\s+(?:architecture|pattern|approach)", 1),
    (r"data\s+(?:flows?|is sent|goes)\s+(?:from|to|through)\s+(.{5,100})", 1),
]
EXPLANATIONS = [
    (r"(.{10,100}?)\s+because\s+(.{10,150})", 2),
    (r"(.{10,100})\s+(?:in order to|so that|which allows|which enables)\s+(.{10,150})", 2),
    (r"(?:the reason (?:is|was)|this is why|that's why)[:\s]+(.{10,200})", 1),
    (r"(?:this|it|we)\s+(?:need|require|must)\s+(.{10,150})\s+(?:to|for|because)", 1),
]
CONFIG = [
    (r"(?:the\s+)?(\w+)\s+defaults?\s+to\s+(\d+\s*\w*)", 2),
    (r"(?:requires|depends on|needs)\s+([A-Za-z][\w\s]{4,50})", 1),
    (r"(?:port|timeout|limit|max|min|size|threshold)\s+(?:is|=|:)\s*(\d+\w*)", 1),
    (r"(?:stored|saved|located|found)\s+(?:in|at)\s+([/~][\w./\-]+)", 1),
]
INSIGHTS = [
    r"(?:the )?(?:key|main|important|critical) (?:insight|takeaway|point|thing)",
    r"(?:in )?summary",
    r"(?:this|the) means",
    r"in other words",
    r"the (?:problem|issue|challenge) (?:is|was)",
    r"the (?:solution|fix|answer) (?:is|was)",
    r"(?:what|here's what) (?:this|we|you) (?:need|should)",
    r"because of this",
    r"as a result",
    r"therefore",
    r"consequently",
    r"this is why",
    r"the reason (?:is|was|being)",
    r"to (?:summarize|recap|sum up)",
    r"in conclusion",
    r"the (?:bottom line|upshot)",
    r"(?:essentially|fundamentally|basically),",
    r"(?:here are|the following|these are) (?:the )?(?:\d+|several|some|a few)",
]
ENDPOINTS = [
    (r"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+['\"]?(/[\w\-{}/:.?&=]+)['\"]?", 2),
    (r"@[\w.]+\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]", 2),
    (r"app\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]", 2),
    (r"['\"](/(?:api/)?v\d+/[\w\-{}/]+)['\"]:\s*\{", 1),
]
TECH_STACK = [
    rf"(?:uses?|using|built with|powered by|runs? on|based on|written in)\s+({_TECH})",
    rf"(?:chose|selected|picked|went with|decided on)\s+({_TECH})",
    rf"({_TECH})\s+(?:handles?|manages?|provides?|supports?|server|client|app)",
    rf"({_TECH})\s*(?:v?\d+\.[\d.]+|\d+)",
    rf"(?:the|our|this)\s+({_TECH})\s+(?:app|api|server|service|project)",
]
TECH_ENTITIES = [
    rf"(?:uses?|using|built with|powered by|runs? on|based on|written in)\s+({_TECH})",
    rf"(?:chose|selected|picked|went with|decided on|migrated to)\s+({_TECH})",
    rf"({_TECH})\s+(?:server|client|app|api|service|database|db|cache|components?)",
    rf"(?:the|our|this)\s+({_TECH})\s+(?:app|api|server|service|project|backend|frontend)",
    rf"({_TECH})\s*(?:v?\d+\.[\d.]+)",
    rf"(?:stored|persisted|saved)\s+(?:in|with|using)\s+({_TECH})",
    rf"({_TECH})\s+(?:for the|as the)\s+(?:backend|frontend|database|cache|api)",
]
# Fixed values: (expression, has a rationale, has an alternative, alternative first).
DECISION_ENTITIES = [
    (r"(?:decided on|chose|went with)\s+(.{5,60}?)\s+(?:instead of|rather than|over)\s+([^.]{5,60}?)(?:\s+for\s+|$|\.)", False, True, False),
    (r"(?:instead of|rather than)\s+(.{5,60}?)[,.]?\s*(?:we |I )?(?:use|chose|using|went with)\s+(.{5,60})", False, True, True),
    (r"(?:we |I )?(?:decided|chose|went with|opted for)\s+(.{5,80}?)\s+because(?:\s+of)?\s+(.{10,100})", True, False, False),
    (r"(?:we |I )?(?:decided|chose|went with|opted for)\s+(.{5,80}?)\s+since\s+(.{10,100})", True, False, False),
    (r"(?:we |I )?(?:decided|chose|went with|opted for)\s+(.{5,80}?)\s+for\s+(.{10,60})", True, False, False),
    (r"(?:we |I )?(?:decided to|chose to|going with|opted to)\s+(.{10,80})", False, False, False),
    (r"(?:the )?decision (?:was |is )?to\s+(.{10,80})", False, False, False),
]

#: (expression, group) whose finds are in the column finds; none: expressions are run where they are used.
_SHARED: ContextVar[list | None] = ContextVar("shared", default=None)


def _all(pattern: str, group: int, flags: str = "") -> Column:
    shared, key = _SHARED.get(), (flags + pattern, group)
    if shared is None:
        return F.regexp_extract_all("content", F.lit(flags + pattern), F.lit(group))
    if key not in shared:
        shared.append(key)
    return F.get("finds", F.lit(shared.index(key)))


def _groups(pattern: str, n: int, join: str, flags: str = "(?i)") -> Column:
    """Array of each match's groups, joined and trimmed."""
    if n == 0:
        return F.transform(_all(f"({pattern})", 1, flags), lambda x: F.trim(x))
    if n == 1:
        return F.transform(_all(pattern, 1, flags), lambda x: F.trim(x))
    return F.transform(F.arrays_zip(_all(pattern, 1, flags).alias("a"), _all(pattern, 2, flags).alias("b")), lambda x: F.trim(F.concat_ws(join, F.nullif(x["a"], F.lit("")), F.nullif(x["b"], F.lit("")))))


def _between(lo: int, hi: int):
    return lambda x: (F.char_length(x) > lo) & (F.char_length(x) < hi)


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _with(array: Column, confidence) -> Column:
    return F.transform(array, lambda x: F.struct(x.alias("pattern"), F.lit(confidence).cast("double").alias("confidence")))


def _imports() -> Column:
    found = _all(r"^(from\s+[\w.]+\s+import\s+[\w,\s*]+|import\s+[\w,\s.]+)$", 1, "(?m)")
    return _with(F.filter(F.transform(found, _squeezed), lambda x: F.char_length(x) > 10), 0.5)


def _facts() -> Column:
    return _with(F.filter(F.concat(*[_groups(p, 0, "", "") for p in FACTS]), _between(10, 200)), 0.5)


def _commands() -> Column:
    pattern = r"(?:^|\n)[$>]\s*(.+?)(?:\n|$)|`([^`]+)`|(?:run|execute|use):\s*`([^`]+)`"
    zipped = F.arrays_zip(*[_all(pattern, g, "(?m)").alias(f"g{g}") for g in (1, 2, 3)])
    found = F.transform(zipped, lambda x: F.trim(F.coalesce(F.nullif(x["g1"], F.lit("")), F.nullif(x["g2"], F.lit("")), x["g3"])))
    return _with(F.filter(F.filter(found, _between(5, 200)), lambda x: x.rlike("^(?:" + "|".join(rules.COMMAND_STARTS) + ")")), 0.5)


def _code() -> Column:
    functions = F.filter(_all(r"(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*(?:->[\w\[\],\s|]+)?:", 1), lambda x: ~x.startswith("_"))
    classes = _all(r"class\s+(\w+)\s*(?:\([^)]*\))?:", 1)
    return _with(F.concat(F.transform(functions, lambda x: F.concat(F.lit("def "), x, F.lit("(...)"))), F.transform(classes, lambda x: F.concat(F.lit("class "), x))), 0.5)


def _blocks() -> Column:
    pattern = r"```(\w*)\n(.*?)```"
    zipped = F.transform(F.arrays_zip(_all(pattern, 1, "(?s)").alias("l"), _all(pattern, 2, "(?s)").alias("c")), lambda x: F.struct(F.lower(x["l"]).alias("l"), F.trim(F.regexp_replace(F.regexp_replace(x["c"], r"^\s+", ""), r"\s+$", "")).alias("c")))
    kept = F.filter(zipped, lambda x: (F.char_length(x["c"]) >= 20) & (F.char_length(x["c"]) <= 2000) & ~x["c"].rlike("^(?:Error:|Traceback)"))
    return F.transform(kept, lambda x: F.struct(F.when(x["l"] != "", F.concat(F.lit("["), x["l"], F.lit("]\n"), x["c"])).otherwise(x["c"]).alias("pattern"), F.when(x["l"] != "", 0.7).otherwise(0.5).alias("confidence")))


def _listed(patterns: list, join: str, lo: int, hi: int, confidence: float) -> Column:
    return _with(F.filter(F.concat(*[_groups(p, n, join) for p, n in patterns]), _between(lo, hi)), confidence)


def _insights() -> Column:
    parts = F.transform(F.split("content", r"\n\s*\n|\n(?=#{1,3}\s)"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", ""))
    letters = lambda x: F.char_length(F.regexp_replace(x, r"[^\p{L}]", ""))
    fits = lambda x: (F.char_length(x) >= 100) & (F.char_length(x) <= 800) & ~x.startswith("```") & (letters(x) >= 0.5 * F.char_length(x)) & x.rlike("(?i)" + "|".join(INSIGHTS))
    return F.transform(F.filter(parts, fits), lambda x: F.struct(_squeezed(x).alias("pattern"), F.when(x.rlike("(?i)" + "|".join(INSIGHTS[:8])), 0.75).otherwise(0.6).alias("confidence")))


def _config() -> Column:
    found = F.filter(F.concat(*[_groups(p, n, " ") for p, n in CONFIG]), _between(3, 150))
    found = F.filter(found, lambda x: ~tx.may_contain_secrets(x))
    names = F.filter(_all(r"(?:set|export)\s+([A-Z_][A-Z0-9_]+)\s*=", 1), lambda x: ~F.lower(x).rlike("|".join(rules.SENSITIVE_NAMES)))
    return F.concat(_with(found, 0.65), _with(F.transform(names, lambda x: F.concat(x, F.lit(" environment variable is configured"))), 0.5))


def _dependencies() -> Column:
    patterns = [rf"(?:requires?|needs?|depends on|dependency:?)\s*({_PACKAGE})", rf"^({_PACKAGE})", rf"pip install[^\n]*?({_PACKAGE})", rf'"({_PACKAGE})"']
    found = F.transform(F.concat(*[_all(p, 1, "(?im)") for p in patterns]), lambda x: F.regexp_replace(x, r"\s+", ""))
    return _with(F.array_distinct(F.filter(found, lambda x: F.char_length(x) > 5)), 0.85)


def _endpoints() -> Column:
    both = [F.transform(F.arrays_zip(_all(p, 1, "(?i)").alias("a"), _all(p, 2, "(?i)").alias("b")), lambda x: F.concat(F.upper(x["a"]), F.lit(" "), x["b"])) if n == 2 else _all(p, 1, "(?i)") for p, n in ENDPOINTS]
    return _with(F.array_distinct(F.filter(F.concat(*both), lambda x: F.char_length(x) > 3)), 0.9)


def _tech_stack() -> Column:
    """First mention of each technology with up to 30 characters around it."""
    around = []
    for p in TECH_STACK:
        zipped = F.arrays_zip(_all(f"({p})", 1, "(?i)").alias("m"), _all(f"({p})", 2, "(?i)").alias("t"))

        def context(x):
            at = F.instr(F.col("content"), x["m"])
            before = F.least(at - 1, F.lit(30))
            return F.struct(F.lower(x["t"]).alias("t"), _squeezed(F.substring(F.col("content"), at - before, before + F.char_length(x["m"]) + 30)).alias("c"))

        around.append(F.transform(zipped, context))
    none = F.array().cast("array<struct<t:string,c:string>>")
    first = F.aggregate(F.concat(*around), none, lambda seen, x: F.when(F.exists(seen, lambda y: y["t"] == x["t"]), seen).otherwise(F.concat(seen, F.array(x))))
    return _with(F.filter(F.transform(first, lambda x: x["c"]), lambda x: F.char_length(x) > 10), 0.85)


def _tech_names() -> Column:
    return F.array_distinct(F.transform(F.concat(*[_all(p, 1, "(?i)") for p in TECH_ENTITIES]), lambda x: F.lower(x)))


def _tech_text(name: Column) -> Column:
    return F.concat(F.lit("Technology: "), F.initcap(name))


def _decisions() -> Column:
    """Array of n (number of the expression), i, decision, pattern, confidence, has_rationale; all finds."""

    def found(number: int, rationale: bool, alternative: bool, inverted: bool):
        one, two = ("b", "a") if inverted else ("a", "b")
        confidence = 0.8 if alternative else 0.9 if rationale else 0.7

        def row(x, i):
            text = F.concat(F.lit("Decision: "), F.trim(x[one]))
            if rationale or alternative:
                text = F.concat(text, F.lit(" (over " if alternative else " (reason: "), F.trim(x[two]), F.lit(")"))
            return F.struct(F.lit(number).alias("n"), i.alias("i"), F.trim(x[one]).alias("decision"), text.alias("pattern"), F.lit(confidence).alias("confidence"), F.lit(rationale).alias("has_rationale"))

        return row

    arrays = []
    for number, (pattern, rationale, alternative, inverted) in enumerate(DECISION_ENTITIES):
        zipped = F.arrays_zip(_all(pattern, 1, "(?i)").alias("a"), _all(pattern, 2 if rationale or alternative else 1, "(?i)").alias("b"))
        arrays.append(F.transform(zipped, found(number, rationale, alternative, inverted)))
    return F.concat(*arrays)


def _decision_key(decision: Column) -> Column:
    return F.substring(F.lower(decision), 1, 50)


def _first_decisions() -> Column:
    """The first of equal beginnings in a log."""
    none = F.array().cast("array<struct<key:string,pattern:string,confidence:double>>")
    keyed = F.transform(_decisions(), lambda x: F.struct(_decision_key(x["decision"]).alias("key"), x["pattern"].alias("pattern"), x["confidence"].alias("confidence")))
    first = F.aggregate(keyed, none, lambda seen, x: F.when(F.exists(seen, lambda y: y["key"] == x["key"]), seen).otherwise(F.concat(seen, F.array(x))))
    return F.transform(first, lambda x: F.struct(x["pattern"].alias("pattern"), x["confidence"].alias("confidence")))


EXTRACTORS = {
    "import": _imports,
    "fact": _facts,
    "command": _commands,
    "code": _code,
    "code_block": _blocks,
    "decision": lambda: _listed(DECISIONS, " → ", 10, 200, 0.8),
    "architecture": lambda: _listed(ARCHITECTURE, " ", 10, 200, 0.75),
    "tech_stack": _tech_stack,
    "explanation": lambda: _listed(EXPLANATIONS, " ... ", 20, 300, 0.6),
    "insight": _insights,
    "config": _config,
    "dependency": _dependencies,
    "api_endpoint": _endpoints,
    "entity_technology": lambda: _with(F.transform(_tech_names(), _tech_text), 0.85),
    "entity_decision": _first_decisions,
}


#: Kinds whose expressions cost much where they are tried at every place of a text.
COSTLY = ["tech_stack", "explanation"]


def _with_finds(logs: DataFrame, makes: list) -> tuple[DataFrame, list[Column]]:
    """(logs that have a text, with finds; what the functions make of these): one pass over each text for all their expressions."""
    token = _SHARED.set([])
    try:
        made, keys = [make() for make in makes], _SHARED.get()
    finally:
        _SHARED.reset(token)
    rows = logs.filter("content IS NOT NULL")
    return rows.mapInArrow(literals.finder(keys, "content"), StructType([*rows.schema.fields, StructField("finds", ArrayType(ArrayType(StringType())))])), made


def extract(logs: DataFrame, kind: str) -> DataFrame:
    """One row per find: the log's columns, kind, pos, pattern, confidence."""
    if kind == "entity_technology":
        return tech_entities(logs)
    if kind == "entity_decision":
        return decision_entities(logs)
    rows, (found,) = _with_finds(logs, [EXTRACTORS[kind]]) if kind in COSTLY else (logs, [EXTRACTORS[kind]()])
    rows = rows.select(*logs.columns, F.lit(kind).alias("kind"), F.posexplode(found).alias("pos", "found"))
    return rows.select(*logs.columns, "kind", "pos", "found.pattern", "found.confidence")


def tech_entities(logs: DataFrame) -> DataFrame:
    """One row per technology named in a telling context of a log."""
    rows, (names,) = _with_finds(logs, [_tech_names])
    rows = rows.select(*logs.columns, F.lit("entity_technology").alias("kind"), F.posexplode(names).alias("pos", "tech"))
    sub = tx.choose(F.col("tech"), {t: s for s, ts in rules.TECHNOLOGIES.items() for t in ts}, "tool")
    return rows.select(*logs.columns, "kind", "pos", _tech_text(F.col("tech")).alias("pattern"), F.lit(0.85).alias("confidence"), sub.alias("subcategory"))


def decision_entities(logs: DataFrame) -> DataFrame:
    """Decisions with their rationale or alternative; the first of equal beginnings in a log."""
    rows = logs.select("*", F.explode(_decisions()).alias("d")).withColumn("key", _decision_key(F.col("d.decision")))
    first = rows.withColumn("first", F.row_number().over(Window.partitionBy("log_id", "key").orderBy("d.n", "d.i"))).filter("first = 1")
    return first.select(*logs.columns, F.lit("entity_decision").alias("kind"), (F.col("d.n") * 1000 + F.col("d.i")).cast("int").alias("pos"), "d.pattern", "d.confidence", "d.has_rationale")


def extract_all(logs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All extractors in fixed order in one pass over the logs; the first find of equal text wins within a log."""
    kinds = kinds or list(EXTRACTORS)

    def tag(n: int, k: str):
        return lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.lit(k).alias("kind"), x["pattern"].alias("pattern"), x["confidence"].cast("double").alias("confidence"))

    made = lambda n, k: lambda: F.transform(EXTRACTORS[k](), tag(n, k))
    rows, tagged = _with_finds(logs.select("log_id", "ts", "project_id", "session_id", "content"), [made(n, k) for n, k in enumerate(kinds)])
    rows = rows.select("log_id", "ts", "project_id", "session_id", F.explode(F.concat(*tagged)).alias("f")).select("log_id", "ts", "project_id", "session_id", "f.*")
    best = rows.groupBy("log_id", "pattern").agg(F.min_by(F.struct("ts", "project_id", "session_id", "kind", "confidence"), F.struct("n", "i")).alias("r"))
    return best.select("log_id", "pattern", "r.*")


def line_patterns(logs: DataFrame, min_length: int = 30) -> DataFrame:
    """Every line as a pattern: log_id, ts, project_id, session_id, kind, pattern, confidence."""
    rows = logs.select("log_id", "ts", "project_id", "session_id", F.explode(F.split("content", "\n")).alias("pattern"))
    return rows.filter(F.char_length("pattern") >= min_length).withColumns({"kind": F.lit("line"), "confidence": F.lit(0.5)})


def aggregate_patterns(extracted: DataFrame, min_length: int = 30) -> DataFrame:
    """One row per text: occurrences, first and last time, highest confidence, first log; secret-like texts are left out."""
    rows = extracted.filter((F.char_length("pattern") >= min_length) & ~tx.may_contain_secrets(F.col("pattern")))
    first = F.struct("ts", "log_id")
    return rows.groupBy(F.sha2("pattern", 256).alias("pattern_hash")).agg(
        F.first("pattern").alias("pattern"), F.min_by("kind", first).alias("kind"), F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max("confidence").alias("confidence"), F.min_by("log_id", first).alias("log_id"), F.min_by("project_id", first).alias("project_id"), F.min_by("session_id", first).alias("session_id"),
    ).withColumn("status", F.lit("pending"))


def merge_patterns(state: DataFrame, new: DataFrame) -> DataFrame:
    """State after new partial aggregates; the state's status stays."""
    rows = state.withColumn("age", F.lit(0)).unionByName(new.select(*state.columns).withColumn("age", F.lit(1)))
    first = F.struct("age", "first_seen", "log_id")
    keep = [c for c in state.columns if c not in ("pattern_hash", "count", "first_seen", "last_seen", "confidence")]
    return rows.groupBy("pattern_hash").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("confidence").alias("confidence"), *[F.min_by(c, first).alias(c) for c in keep]).select(*state.columns)


def pattern_score(patterns: DataFrame, as_of: Column) -> DataFrame:
    days = F.floor(tx.days_between(F.col("last_seen"), as_of))
    return patterns.withColumn("score", F.least(F.col("count") / 10, F.lit(1.0)) * F.pow(F.lit(0.5), days / 7) * F.col("confidence"))


def candidates(scored: DataFrame, min_count: int = 3) -> DataFrame:
    return scored.filter((F.col("count") >= min_count) & F.col("status").isin("pending", "approved")).orderBy(F.desc("score"), F.desc("count"), "pattern_hash")


def set_status(patterns: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: pattern_hash, new_status."""
    return patterns.join(updates, "pattern_hash", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def expire(patterns: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    old = (F.col("status") == "pending") & (F.col("last_seen") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return patterns.withColumn("status", F.when(old, "rejected").otherwise(F.col("status")))


def admit_patterns(patterns: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Mined memories from patterns: not commands or snippets; facts become project memories, else patterns."""
    rows = patterns.filter((F.col("confidence") >= min_confidence) & ~F.col("kind").isin("command", "snippet"))
    return rows.select(F.col("pattern").alias("content"), F.when(F.col("kind") == "fact", "project").when(F.col("kind") == "command", "reference").otherwise("pattern").alias("memory_type"), F.lit("mined").alias("source"), F.col("first_seen").alias("created_at"), F.col("log_id").alias("source_log_id"), "project_id", "session_id", "kind")


def promote_frequent(patterns: DataFrame, mem: DataFrame, min_count: int = 3) -> DataFrame:
    """ids of memories whose text is a pattern that occurred often."""
    often = patterns.filter(F.col("count") >= min_count).select("pattern_hash")
    return mem.select("id", F.sha2("content", 256).alias("pattern_hash")).join(often, "pattern_hash", "left_semi").select("id")


def entity_links(mem: DataFrame, edges: DataFrame) -> DataFrame:
    """Within one source log: other rows mention entities, decisions depend on technologies. mem: id, source_log_id, kind."""
    a = mem.select(F.col("id").alias("from_id"), "source_log_id", F.col("kind").alias("from_kind"))
    b = mem.filter(F.col("kind").startswith("entity_")).select(F.col("id").alias("to_id"), "source_log_id", F.col("kind").alias("to_kind"))
    pairs = a.join(b, "source_log_id")
    kind = F.when(~F.col("from_kind").startswith("entity_"), "mentions").when((F.col("from_kind") == "entity_decision") & (F.col("to_kind") == "entity_technology"), "depends_on")
    return link(edges, pairs.withColumn("relation_type", kind).filter("relation_type IS NOT NULL"), mem, rules.RELATIONS)


def mining_stats(patterns: DataFrame, min_count: int = 3) -> DataFrame:
    return patterns.groupBy("status").agg(F.count("*").alias("n"), F.sum((F.col("count") >= min_count).cast("long")).alias("n_frequent"), F.sum("count").alias("occurrences"))

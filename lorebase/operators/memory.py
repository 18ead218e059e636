"""Ingest, admission, exact deduplication, listing, deletion and audit of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text as tx


def recent_outputs(logs: DataFrame, as_of: Column, hours: int = 24, project_id: str | None = None, session_id=None) -> DataFrame:
    out = logs.filter(F.col("ts") > as_of - F.expr(f"INTERVAL {hours} HOURS"))
    if project_id is not None:
        out = out.filter(F.col("project_id") == project_id)
    return out if session_id is None else out.filter(F.col("session_id") == session_id)


def last_turns(turns: DataFrame, user_chars: int = 500, min_chars: int = 20, max_chars: int = 100_000) -> DataFrame:
    """Per conversation its last non-empty user and assistant texts as one text; none without an assistant."""

    def last(role: str) -> Column:
        use = (F.col("role") == role) & (F.trim("text") != "")
        return F.max_by("text", F.when(use, F.col("turn")))

    out = turns.groupBy("conv_id").agg(F.when(F.max(F.when((F.col("role") == "user") & (F.trim("text") != ""), 1)).isNotNull(), last("user")).alias("u"), F.when(F.max(F.when((F.col("role") == "assistant") & (F.trim("text") != ""), 1)).isNotNull(), last("assistant")).alias("a"))
    both = F.when(F.col("u").isNull(), F.concat(F.lit("ASSISTANT: "), "a")).otherwise(F.concat(F.lit("USER: "), F.substring("u", 1, user_chars), F.lit("\n\nASSISTANT: "), F.col("a")))
    return out.filter("a IS NOT NULL").select("conv_id", F.substring(both, 1, max_chars).alias("content")).filter(F.char_length("content") >= min_chars)


def ingest_issues(lines: DataFrame, include_closed: bool = False, max_chars: int = 100_000) -> DataFrame:
    """Issue exports, one JSON object per line in column value; other lines are skipped."""
    schema = "id string, title string, description string, notes string, design string, status string, priority int, issue_type string"
    issue = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("i")).filter("i.id IS NOT NULL OR i.title IS NOT NULL").select("i.*")
    issue = issue.withColumns({"status": F.coalesce("status", F.lit("open")), "priority": F.coalesce("priority", F.lit(2)), "issue_type": F.coalesce("issue_type", F.lit("task"))})
    if not include_closed:
        issue = issue.filter("status <> 'closed'")
    part = lambda name: F.when(F.trim(name) != "", F.concat(F.lit(f"**{name.capitalize()}:** "), F.col(name)))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.coalesce(F.concat(F.lit(" ("), F.col("id"), F.lit(")")), F.lit(""))), part("description"), part("notes"), part("design"))
    return issue.select("id", F.substring(body, 1, max_chars).alias("content"), F.array(F.lit("beads"), F.col("issue_type"), F.concat(F.lit("p"), F.col("priority").cast("string"))).alias("tags"))


def validate(df: DataFrame, max_len: int = 100_000, max_tags: int = 20, tags: str | None = None) -> DataFrame:
    """Adds reject_reason (null: valid) and, with tags, the trimmed non-empty tags."""
    reason = F.when(F.col("content").isNull() | (F.trim("content") == ""), "blank").when(F.char_length("content") > max_len, "too_long")
    if tags:
        df = df.withColumn(tags, F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))
        reason = reason.when(F.size(tags) > max_tags, "too_many_tags")
    return df.withColumn("reject_reason", reason)


def upsert_exact(existing: DataFrame | None, incoming: DataFrame, project_scoped: bool = True) -> DataFrame:
    """One row per content (and project): the first row's fields, copies counted, latest access, union of tags.

    Rows need id, content, project_id and ts; access_count and tags are optional.
    """

    def shaped(df: DataFrame, age: int) -> DataFrame:
        tags = F.col("tags") if "tags" in df.columns else F.array().cast("array<string>")
        count = F.col("access_count").cast("long") if "access_count" in df.columns else F.lit(0).cast("long")
        return df.select("id", "content", "project_id", "ts", count.alias("access_count"), tags.alias("tags"), F.lit(age).alias("age"))

    rows = shaped(incoming, 1) if existing is None else shaped(existing, 0).unionByName(shaped(incoming, 1))
    key = F.sha2(F.concat(F.coalesce(F.concat("project_id", F.lit(":")), F.lit("")), "content") if project_scoped else F.col("content"), 256)
    first = F.struct("age", "ts", "id")
    out = rows.withColumn("content_hash", key).groupBy("content_hash").agg(
        F.min_by("id", first).alias("id"), F.min_by("content", first).alias("content"), F.min_by("project_id", first).alias("project_id"),
        (F.min_by("access_count", first) + F.count("*") - 1).alias("access_count"), F.max("ts").alias("last_accessed_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
    )
    return out


def admit(df: DataFrame) -> DataFrame:
    """Trust by source, importance and category of each new row; extracted_at only of mined ones."""
    mined = F.col("source") == "mined"
    return df.withColumns({"trust_score": F.when(mined, 0.7).otherwise(1.0), "importance_score": tx.importance(F.col("content")), "category": tx.category(F.col("content")), "extracted_at": F.when(mined, F.col("created_at"))})


def list_memories(mem: DataFrame, kind: str | None = None, project: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    if kind is not None:
        mem = mem.filter(F.col("memory_type") == kind)
    if project is not None:
        mem = mem.filter(in_project(F.col("project_id"), project))
    return mem.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def in_project(column: Column, project: str, include_global: bool = True) -> Column:
    return (column == project) | column.isNull() if include_global else F.coalesce(column == project, F.lit(False))


def by_keys(mem: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose column `on` is among the keys: lookup by id, hash or source log."""
    return mem.join(keys.select(on).distinct(), on, "left_semi")


def by_tag(mem: DataFrame, tag: str, limit: int = 50) -> DataFrame:
    return mem.filter(F.array_contains("tags", tag)).orderBy(F.desc("access_count"), F.desc("created_at"), "id").limit(limit)


def projects(mem: DataFrame, sessions: DataFrame) -> DataFrame:
    ids = mem.select("project_id").unionByName(sessions.select(F.col("project_path").alias("project_id"))).filter("project_id <> ''").distinct()
    return ids.withColumn("label", F.element_at(F.split("project_id", "/"), -1))


def forget(mem: DataFrame, ids: DataFrame, dependents: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """The tables without the given ids, and audit rows with a preview. dependents: table name -> rows with memory_id."""
    gone = mem.join(ids.select("id").distinct(), "id", "left_semi")
    out = {name: df.join(ids.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_anti") for name, df in dependents.items()}
    audit = gone.select(F.lit("delete_memory").alias("operation"), F.col("id").alias("target_id"), F.substring("content", 1, 100).alias("details"), as_of.alias("created_at"))
    return out | {"memories": mem.join(ids.select("id").distinct(), "id", "left_anti"), "audit": audit}


def audit_history(audit: DataFrame, limit: int = 50, operation: str | None = None) -> DataFrame:
    if operation is not None:
        audit = audit.filter(F.col("operation") == operation)
    return audit.orderBy(F.desc("created_at"), F.desc("target_id")).limit(min(limit, 500))


def purge(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows that are not older than so many days."""
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def chunk_plain(df: DataFrame, text: str = "content", min_length: int = 10, separator: str = r"\n\s*\n", source: str | None = None) -> DataFrame:
    """List items if there is any, else paragraphs; short ones only if they look like key: value."""
    marker = r"(?:[-*+]|\d+[.)])\s+"
    listed = F.col(text).rlike(rf"(?m)^\s*{marker}")
    parts = F.when(listed, F.split(text, rf"(?m)^(?=\s*{marker})")).otherwise(F.split(text, separator))
    out = df.select("*", F.posexplode(parts).alias("pos", "chunk")).withColumn("chunk", F.trim(F.regexp_replace(F.trim(F.regexp_replace("chunk", r"\s+$", "")), rf"^\s*{marker}", "")))
    n = F.char_length("chunk")
    out = out.filter((n > min_length) | ((n >= 5) & F.col("chunk").rlike(r"^[\w.-]+\s*[:=]\s*\S")))
    return out.withColumn("chunk", F.concat(F.lit("["), F.col(source), F.lit("] "), F.col("chunk"))) if source else out


def chunk_markdown(df: DataFrame, key: str, text: str = "content", min_length: int = 10) -> DataFrame:
    """Blocks between blank lines, headings and list starts, led by the heading that they stand under."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    by = Window.partitionBy(key).orderBy("pos")
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    item = F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+")
    blank = F.trim("line") == ""
    lines = lines.withColumns({"heading": heading, "section": F.last(heading, ignorenulls=True).over(by), "block": F.sum((heading.isNotNull() | blank | item).cast("int")).over(by)})
    blocks = lines.filter(F.col("heading").isNull() & (F.trim("line") != "")).groupBy(key, "block").agg(F.first("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("chunk"))
    chunk = F.trim(F.regexp_replace("chunk", r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    n = F.char_length("chunk")
    out = blocks.withColumn("chunk", chunk).filter((n > min_length) | ((n >= 5) & F.col("chunk").rlike(r"^[\w.-]+\s*[:=]\s*\S")))
    return out.withColumn("chunk", F.when(F.col("section").isNotNull(), F.concat(F.lit("["), "section", F.lit("] "), "chunk")).otherwise(F.col("chunk")))


def flag_binary(files: DataFrame, content: str = "content", sample: int = 8192, ratio: float = 0.30) -> DataFrame:
    """Adds is_binary: a NUL byte, or over ratio of odd control bytes, in the first bytes."""
    head = F.decode(F.substring(F.col(content), 1, sample), "ISO-8859-1")
    odd = F.char_length(head) - F.char_length(F.regexp_replace(head, r"[\x00-\x06\x0B\x0E-\x1A\x1C-\x1F\x7F]", ""))
    return files.withColumn("is_binary", F.coalesce(head.contains("\u0000") | (odd > ratio * F.char_length(head)), F.lit(False)))


def seed(files: DataFrame, memory_type: str = "project", max_len: int = 100_000, separator: str = r"\n\s*\n") -> tuple[DataFrame, DataFrame]:
    """(created rows, report): chunks of every file (path, content) with exact copies skipped."""
    chunks = chunk_plain(files, separator=separator).select("path", "pos", F.col("chunk").alias("content"))
    valid = validate(chunks, max_len)
    first = F.row_number().over(Window.partitionBy(F.sha2("content", 256)).orderBy("path", "pos"))
    marked = valid.withColumn("status", F.when(F.col("reject_reason").isNotNull(), "rejected").when(first > 1, "skipped").otherwise("created"))
    return marked.filter("status = 'created'").select("path", "pos", "content", F.lit(memory_type).alias("memory_type")), marked.groupBy("status").agg(F.count("*").alias("n"))

"""Typed reading of tables, and the views by which the driver's tables stand for the store's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TYPES = ["project", "pattern", "reference", "conversation", "episodic"]
CATEGORIES = ["antipattern", "landmine", "decision", "convention", "preference", "lesson", "constraint", "architecture", "context", "bug", "todo", "workflow", "snippet", "command", "reference", "observation"]
RELATIONS = ["relates_to", "depends_on", "supersedes", "refines", "contradicts", "elaborates", "mentions"]


def _pick(key: str, names: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _ago(days: str) -> str:
    return f"({AS_OF} - ({days}) * INTERVAL '1' DAY)"


#: view -> (table, {column: SQL that both engines read}); {k}: the number in an event's properties.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "memories": (
        "documents",
        {
            "id": "doc_id",
            "content": "text",
            "memory_type": _pick("doc_id % 5", TYPES),
            "source": "CASE WHEN doc_id % 3 = 0 THEN 'mined' ELSE 'manual' END",
            "project_id": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END",
            "session_id": "doc_id % 20",
            "category": _pick("doc_id % 17", CATEGORIES),
            "created_at": _ago("doc_id % 200"),
            "last_accessed_at": f"CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {_ago('doc_id % 40')} END",
            "access_count": "doc_id % 12",
            "retrieved_count": "doc_id % 9",
            "used_count": "CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 4 END",
            "last_used_at": f"CASE WHEN doc_id % 2 = 0 THEN NULL ELSE {_ago('doc_id % 40')} END",
            "is_hot": "doc_id % 10 = 0",
            "is_pinned": "doc_id % 50 = 0",
            "trust_score": "CAST(0.4 AS DOUBLE) + (doc_id % 7) / CAST(10 AS DOUBLE)",
            "importance_score": "(doc_id % 11) / CAST(10 AS DOUBLE)",
            "utility_score": "((CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 4 END) + 1) / CAST(doc_id % 9 + 4 AS DOUBLE)",
        },
    ),
    "access_log": ("events", {"session_id": "user_id", "item": "event_type", "k": "{k}", "ts": "ts", "seq": "event_id"}),
    "injections": ("events", {"memory_id": "{k}", "resource": "event_type", "injected_at": "ts", "session_id": "user_id"}),
    "retrievals": ("events", {"event_id": "event_id", "query_key": "concat(event_type, '-', CAST(user_id % 20 AS VARCHAR(20)))", "memory_id": "{k}", "similarity": "least(CAST(1 AS DOUBLE), value / 100)", "was_used": "event_type = 'purchase'", "created_at": "ts"}),
    "trust_events": ("events", {"memory_id": "{k}", "seq": "event_id", "ts": "ts", "reason": "CASE event_type WHEN 'purchase' THEN 'used_correctly' WHEN 'signup' THEN 'explicitly_confirmed' WHEN 'error' THEN 'outdated' WHEN 'click' THEN 'low_utility' ELSE 'high_similarity_hit' END", "similarity": "CASE WHEN event_type = 'view' THEN least(CAST(1 AS DOUBLE), value / 100) END"}),
    "output_log": ("documents", {"log_id": "doc_id", "content": "text", "ts": f"({AS_OF} - (doc_id % 240) * INTERVAL '1' HOUR)", "project_id": "source", "session_id": "doc_id % 20"}),
    "vectors": ("embeddings", {"memory_id": "vec_id", "embedding": "embedding", "category": "CAST(label AS VARCHAR(10))"}),
    "edges": ("lineitem", {"from_id": "l_partkey", "to_id": "l_suppkey", "relation_type": _pick("(l_linenumber - 1) % 7", RELATIONS)}),
    "runs": ("orders", {"run_id": "o_orderkey", "started_at": "o_orderdate", "failed": "o_orderstatus = 'F'", "n_patterns": "CAST(floor(o_totalprice / 1000) AS BIGINT)"}),
    "turns": ("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
}
DISTINCT = {"edges"}
FILTERS = {"injections": "event_type IN ('view', 'click')", "edges": "l_partkey <> l_suppkey"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; the views' fixed times are meant in UTC, to which the session is set for that."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for costly work on each row: dealt out only where the scan has fewer parts than there are cores, or than take about so many rows each, or where a core's share of rows is less than half of a part.

    A scan has a part for so many bytes of a file, but a row group's rows are all in one of them.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, -(-df.count() // rows))
    if (scanned := df.rdd.getNumPartitions()) < parts:
        return df.repartition(parts)
    total, most = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    return df.repartition(scanned) if most and most * parts > 2 * total else df


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream of its files; a pattern names it, since a table of a single file is no folder to stream from."""
    return spark.readStream.schema(load(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shaped(load(spark, sf_dir, VIEWS[name][0]), name)


def shaped(df: DataFrame, name: str) -> DataFrame:
    """The view's columns from its table, read as a table or as a stream."""
    columns = VIEWS[name][1]
    if name in FILTERS:
        df = df.filter(FILTERS[name])
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    df = df.selectExpr(*[f"{sql.format(k=k)} AS {c}" for c, sql in columns.items()])
    return df.distinct() if name in DISTINCT else df


def sql(name: str) -> str:
    """The view as a DuckDB common table expression."""
    table, columns = VIEWS[name]
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    where = f" WHERE {FILTERS[name]}" if name in FILTERS else ""
    return f"{name} AS (SELECT {'DISTINCT ' * (name in DISTINCT)}{', '.join(f'{s.format(k=k)} AS {c}' for c, s in columns.items())} FROM {table}{where})"


def as_of(text: str = AS_OF) -> Column:
    return F.expr(text)

"""Queries of the streaming forms, of the typed scan and of the vector rebuild.

Each stream reads a whole table, ends when all is read, and its query returns what it wrote to the shared folder; SQL
tells the same as a batch. Where windows are emitted once the watermark has passed them, SQL leaves out the open ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorebase.operators import extract, vectors
from lorebase.plans import extraction, retrieval, store
from lorebase.plans.registry import query
from lorebase.sources.shared import shared_dir
from lorebase.sources.tables import VIEWS, sql, shaped, stream, view
from lorebase.streaming import ordered, streams


def _folder(spark, name):
    return f"{shared_dir(spark)}/lorebase-{name}-{uuid.uuid4().hex}"


def _stream(spark, d, name, *times):
    """The view as a stream; times: columns that become times with a zone, as watermarks ask for."""
    return shaped(stream(spark, d, VIEWS[name][0]), name).withColumns({t: F.col(t).cast("timestamp") for t in times or ["ts"]})


def _written(out, name):
    """All that the stream appends until its input ends."""
    path = _folder(out.sparkSession, name)
    sink = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/out")


def _us(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(" UNION ALL ".join(f"SELECT '{v}' AS source, '{c}' AS field, count({c}) AS n FROM ({sql(v).split(' AS ', 1)[1][1:-1]})" for v, (_, columns) in VIEWS.items() for c in columns))
def src01_scan(spark, d):
    """Values that are not null, by table and column."""
    out = None
    for name, (_, columns) in VIEWS.items():
        counts = view(spark, d, name).agg(*[F.count(c).alias(c) for c in columns]).select(F.lit(name).alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("x")).select("source", "x.*")
        out = counts if out is None else out.unionByName(counts)
    return out


def _letters():
    return lambda texts: [[(t or "").count(chr(97 + i)) for i in range(26)] for t in texts]


@query("SELECT id, CAST(coalesce(list_sum(v), 0) AS DOUBLE) AS total, CAST(coalesce(list_sum(list_transform(v, lambda x, i: x * i)), 0) AS DOUBLE) AS weighted, FALSE AS failed FROM (SELECT id, list_transform(generate_series(97, 122), lambda c: length(content) - length(replace(content, chr(c::INTEGER), ''))) AS v FROM memories)", "memories")
def sto06_rebuild(spark, d):
    """Vectors of letter counts in place of a model's, reduced to two numbers."""
    out = vectors.rebuild_vectors(view(spark, d, "memories"), _letters, 26)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return out.select("id", total.alias("total"), weighted.alias("weighted"), F.col("error").isNotNull().alias("failed"))


@query(f"SELECT doc_id AS log_id, sha256({store._redact_sql()}) AS content_sha256, strftime(ts, '%Y-%m-%d') AS day FROM documents JOIN output_log ON log_id = doc_id WHERE trim(text, ' ') <> '' AND length(text) <= 100000", "output_log")
def str01_logs(spark, d):
    out = _written(streams.stream_logs(_stream(spark, d, "output_log")), "logs")
    return out.select("log_id", F.sha2("content", 256).alias("content_sha256"), F.date_format("day", "yyyy-MM-dd").alias("day"))


_MARK = "mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM access_log)"


@query("+" + _MARK + " SELECT epoch_us(start) AS start_us, item, n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, item, count(*) AS n FROM access_log GROUP BY 1, 2), mark WHERE start + INTERVAL 1 DAY <= mark", "access_log")
def str02_counts(spark, d):
    out = _written(streams.stream_counts(_stream(spark, d, "access_log"), "item", "1 day"), "counts")
    return out.select(_us("start").alias("start_us"), "item", "n")


@query("SELECT DISTINCT sha256(content) AS content_hash FROM output_log", "output_log")
def str03_dedup(spark, d):
    return _written(streams.stream_dedup(_stream(spark, d, "output_log"), "30 days"), "dedup").select("content_hash")


@query("SELECT sha256(content) AS content_hash, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM output_log GROUP BY 1", "output_log")
def str03_copies(spark, d):
    """How often and when each content came, beside the stream of first copies."""
    path = _folder(spark, "copies")
    streams.stream_copies(_stream(spark, d, "output_log"), f"{path}/copies", f"{path}/state").awaitTermination()
    return streams.copies_state(spark, f"{path}/copies").read().select("content_hash", "n", _us("first_seen").alias("first_us"), _us("last_seen").alias("last_us"))


@query(
    "+" + _MARK + """, gaps AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 8 HOUR THEN 1 ELSE 0 END AS opens FROM access_log WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, seq) AS run FROM gaps)
SELECT session_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 8 HOUR) AS end_us, count(*) AS n FROM runs, mark GROUP BY session_id, run, mark HAVING max(ts) + INTERVAL 8 HOUR <= mark""",
    "access_log",
)
def str04_sessions(spark, d):
    out = _written(streams.stream_sessions(_stream(spark, d, "access_log"), "8 hours"), "sessions")
    return out.select("session_id", _us("start").alias("start_us"), _us("end").alias("end_us"), "n")


@query(store.BY_K + "SELECT from_id, to_id, n AS count, epoch_us(last_seen) AS last_seen_us FROM trans", "access_log")
def str05_transitions(spark, d):
    path = _folder(spark, "transitions")
    src = _stream(spark, d, "access_log").select("session_id", F.col("k").alias("item"), "ts", "seq")
    streams.write_transitions(src, path, f"{path}/state").awaitTermination()
    return streams.stitched_transitions(spark, path).select("from_id", "to_id", "count", _us("last_seen").alias("last_seen_us"))


@query(
    "+" + _MARK + """, nexts AS (SELECT k AS from_id, lead(k) OVER w AS to_id, lead(ts) OVER w AS seen FROM access_log WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq))
SELECT from_id, to_id, count(*) AS count, epoch_us(max(seen)) AS last_seen_us FROM nexts, mark WHERE from_id <> to_id AND seen <= mark GROUP BY 1, 2""",
    "access_log",
)
def str05_ordered(spark, d):
    """Transitions by rows' times whatever order they come in, of rows that the watermark has passed."""
    src = _stream(spark, d, "access_log").select("session_id", F.col("k").alias("item"), "ts", "seq")
    with ordered.row_store(spark):
        pairs = _written(ordered.ordered_transitions(src, keep_days=365), "ordered")
    return pairs.groupBy("from_id", "to_id").agg(F.count("*").alias("count"), F.unix_micros(F.max("seen")).alias("last_seen_us"))


@query(retrieval.ATTRIBUTED, "memories")
def str06_attribution(spark, d):
    told = _stream(spark, d, "memories", "created_at").select(F.col("id").alias("memory_id"), "session_id", F.col("created_at").alias("injected_at"))
    heard = retrieval.responses(stream(spark, d, "conversations")).withColumn("ts", F.col("ts").cast("timestamp"))
    return _written(streams.stream_attribution(told, heard, view(spark, d, "memories"), 48), "attribution").distinct()


@query(extraction.MINED)
def str07_mining(spark, d):
    path = _folder(spark, "mining")
    streams.stream_mining(extraction.noted(stream(spark, d, "orders")), f"{path}/mined", f"{path}/state").awaitTermination()
    return streams.mined_state(spark, f"{path}/mined").read().select("pattern_hash", "count", _us("first_seen").alias("first_us"), _us("last_seen").alias("last_us"))

"""Streams return what the batch forms return."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from lorebase.operators import extract, feedback, sequences
from lorebase.sources.tables import view
from lorebase.streaming import streams

FOLDER = "/root/testdata/sf0.001"


def streamed(spark, df, name):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.repartition(1).write.mode("overwrite").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


def run(spark, stream, path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def events(spark):
    return view(spark, FOLDER, "access_log").withColumn("ts", F.col("ts").cast("timestamp"))


def test_transitions(spark, events):
    src, path = streamed(spark, events, "t")
    got = run(spark, streams.stream_transitions(src), path, "s_trans").groupBy("from_id", "to_id").count().collect()
    want = sequences.transitions(events).collect()
    assert {(r.from_id, r.to_id, r["count"]) for r in got} == {(r.from_id, r.to_id, r["count"]) for r in want}


def test_counts(spark, events):
    src, path = streamed(spark, events, "c")
    got = run(spark, streams.stream_counts(src, "item", "1 day"), path, "s_counts", "complete")
    want = events.groupBy(F.date_trunc("day", "ts").alias("start"), "item").count()
    assert {(r.start, r["item"], r.n) for r in got.collect()} == {(r.start, r["item"], r["count"]) for r in want.collect()}


def test_dedup_and_logs(spark):
    logs = view(spark, FOLDER, "output_log").withColumn("ts", F.col("ts").cast("timestamp"))
    src, path = streamed(spark, logs, "d")
    got = run(spark, streams.stream_dedup(src, "30 days"), path, "s_dedup").count()
    assert got == logs.select("content").distinct().count()
    src, path = streamed(spark, logs, "l")
    assert run(spark, streams.stream_logs(src), path, "s_logs").count() == logs.count()


def test_sessions_do_not_lose_rows(spark, events):
    src, path = streamed(spark, events, "e")
    got = run(spark, streams.stream_sessions(src, "2 days"), path, "s_sessions", "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_mining(spark):
    logs = view(spark, FOLDER, "output_log").withColumns({"ts": F.col("ts").cast("timestamp"), "content": F.lit("This project uses Spark and Parquet for all tables")}).limit(20)
    src, path = streamed(spark, logs, "m")
    streams.stream_mining(src, f"{path}/state", f"{path}/cp2", ["fact"]).awaitTermination(120)
    got = streams.mined_state(spark, f"{path}/state").read().agg(F.sum("count")).first()[0]
    assert got == extract.aggregate_patterns(extract.extract_all(logs, ["fact"])).agg(F.sum("count")).first()[0] == 20


def test_attribution(spark):
    start = "TIMESTAMP '2024-01-10 00:00:00'"
    mem = spark.createDataFrame([(1, "uses load_table() daily"), (2, "nothing here"), (3, "see src/app.py and ")], "id long, content string")
    told = spark.range(1, 7).select(((F.col("id") - 1) % 3 + 1).alias("memory_id"), (F.col("id") % 2).alias("session_id"), F.expr(f"{start} + make_interval(0, 0, 0, 0, cast(id as int))").alias("injected_at"))
    heard = spark.createDataFrame([(10, 1, 4, "I call LOAD_TABLE() now"), (11, 0, 8, "src/app.py is fine"), (12, 1, 0, "load_table() too early"), (13, 0, 40, "load_table() too late"), (14, 0, 9, "nothing")], "response_id long, session_id long, hour int, text string")
    heard = heard.select("response_id", "session_id", F.expr(f"{start} + make_interval(0, 0, 0, 0, hour)").alias("ts"), "text")
    left, path = streamed(spark, told, "i")
    right, _ = streamed(spark, heard, "r")
    got = {(r.memory_id, r.response_id) for r in run(spark, streams.stream_attribution(left, right, mem), path, "s_attr").collect()}
    want = {(r.memory_id, r.response_id) for r in feedback.attribute_usage(told, mem, heard).collect()}
    assert got == want == {(1, 10), (3, 11)}


def test_attribution_over_batches(spark):
    """What comes in a later batch meets what was kept, whichever side came first; the window holds to the microsecond, and no text moves with a pair."""
    start = "TIMESTAMP '2024-01-10 00:00:00'"
    mem = spark.createDataFrame([(n, f"see src/app.py and word_{n}") for n in range(1, 4)], "id long, content string")
    told = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 86_400_000_000, 1), (3, None, 0, 0)], "memory_id long, session_id long, us long, n int")
    heard = spark.createDataFrame([(10, 1, 0, 1, "SRC/APP.PY"), (11, 1, 86_400_000_000, 0, "src/app.py word_2"), (12, 1, 86_400_000_001, 1, "src/app.py"), (13, 1, 5, 0, "word_3"), (14, 1, 6, 0, None)], "response_id long, session_id long, us long, n int, text string")
    at = lambda df, name: df.withColumn(name, F.expr(f"timestamp_micros(unix_micros({start}) + us)")).drop("us")
    told, heard, path = at(told, "injected_at"), at(heard, "ts"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for n in range(2):
        told.filter(F.col("n") == n).drop("n").repartition(1).write.parquet(f"{path}/i{n}")
        heard.filter(F.col("n") == n).drop("n").repartition(1).write.parquet(f"{path}/r{n}")
    read = lambda df, kind: spark.readStream.schema(df.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{kind}*")
    out = streams.stream_attribution(read(told, "i"), read(heard, "r"), mem, 24)
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.memory_id, r.response_id) for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()}
    assert got == {(1, 10), (1, 11), (2, 11), (2, 12)}
    assert "StreamingSymmetricHashJoin" not in out._jdf.queryExecution().toString()


def test_stitched_transitions(spark):
    """Three batches in order of time, sessions that skip a batch, repeat an item over a border, or begin late."""
    rows = [("a", "x", 1, 1), ("a", "y", 2, 2), ("a", "y", 11, 3), ("a", "z", 12, 4), ("b", "x", 3, 5), ("b", "w", 21, 6), ("c", "q", 22, 7), (None, "x", 4, 8), (None, "y", 24, 9)]
    log = spark.createDataFrame(rows, "session_id string, item string, second int, seq int").withColumn("ts", F.expr("timestamp_seconds(second)")).drop("second")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    src = spark.readStream.schema(log.schema).parquet(f"{path}/in*")
    for n in range(3):  # each start of the query takes what is new as a batch
        log.filter(F.floor(F.unix_seconds("ts") / 10) == n).repartition(1).write.parquet(f"{path}/in{n}")
        streams.write_transitions(src, f"{path}/out", f"{path}/cp").awaitTermination(120)
    got = streams.stitched_transitions(spark, f"{path}/out").collect()
    want = sequences.transitions(log).collect()
    assert sorted(map(tuple, got)) == sorted((r.from_id, r.to_id, r["count"], r.last_seen) for r in want) and len(want) == 3


def test_snapshots_bear_retries_and_compaction(spark):
    """Nine batches, compacted by three; batches run again before, at and after a compaction."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/state"
    state = streams.copies_state(spark, path, every=3)
    batch = lambda n: spark.createDataFrame([("all", 1, dt.datetime(2024, 1, n + 1), dt.datetime(2024, 1, n + 1)), (f"k{n % 4}", 10, dt.datetime(2024, 1, n + 1), dt.datetime(2024, 1, n + 2))], "content_hash string, n long, first_seen timestamp, last_seen timestamp")
    for n in range(8):
        state.write(batch(n), n)
        state.write(batch(n), n)
        if n >= 3:
            state.write(batch(2), 2)  # behind the fence
    got = {r.content_hash: (r.n, r.first_seen.day, r.last_seen.day) for r in state.read().collect()}
    assert got == {"all": (8, 1, 8), "k0": (20, 1, 6), "k1": (20, 2, 7), "k2": (20, 3, 8), "k3": (20, 4, 9)}
    assert state._finished("upto") == [5] and state._finished("batch") == [6, 7]


def test_copies(spark):
    logs = view(spark, FOLDER, "output_log").withColumn("ts", F.col("ts").cast("timestamp"))
    src, path = streamed(spark, logs, "k")
    streams.stream_copies(src, f"{path}/state", f"{path}/cp3").awaitTermination(120)
    got = streams.copies_state(spark, f"{path}/state").read()
    assert got.agg(F.sum("n")).first()[0] == logs.count() and got.count() == logs.select("content").distinct().count()

"""Transitions of rows that come out of order."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from lorebase.operators import sequences
from lorebase.streaming import ordered


def batches(spark, parts, **options):
    """Rows (session, item, second, seq) of each part as one start of the stream, with the pairs that it has told so far."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "session_id string, item string, second long, seq long"
    src = spark.readStream.schema("session_id string, item string, ts timestamp, seq long").parquet(f"{path}/in*")
    told = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).select("session_id", "item", F.timestamp_seconds("second").alias("ts"), "seq").repartition(2).write.parquet(f"{path}/in{n}")
        with ordered.row_store(spark):
            out = ordered.ordered_transitions(src, **options).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
            out.trigger(availableNow=True).start().awaitTermination()
        told.append(sorted((r.from_id, r.to_id, r.seen.replace(tzinfo=dt.UTC).timestamp()) for r in spark.read.schema("from_id string, to_id string, seen timestamp").parquet(f"{path}/out").collect()))
    return told


def test_out_of_order_over_three_batches(spark):
    """Rows come up to 50 seconds late, over batches; the last row lets all others go. Same counts as the batch form."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["x", "y", "z", None]), rng.randrange(300), n) for n in range(240)]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 50))
    third = len(rows) // 3
    told = batches(spark, [rows[:third], rows[third : 2 * third], [*rows[2 * third :], ("end", "x", 4000, 999)]], late="60 seconds")
    log = spark.createDataFrame(rows, "session_id string, item string, second long, seq long").withColumn("ts", F.timestamp_seconds("second"))
    want = {(r.from_id, r.to_id): (r["count"], r.last_seen) for r in sequences.transitions(log).collect()}
    last = told[-1]
    got = {pair: (sum(t[:2] == pair for t in last), dt.datetime.fromtimestamp(max(t[2] for t in last if t[:2] == pair), dt.UTC).replace(tzinfo=None)) for pair in {t[:2] for t in last}}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) == 6
    assert 0 < len(told[0]) < len(told[1]) < len(told[2])  # pairs leave as the watermark passes them


def test_sessions_are_forgotten_and_late_rows_dropped(spark):
    day = 86_400  # no row at second 0: the watermark begins there
    parts = [[("a", "x", 10, 1), ("b", "p", 1, 2), ("b", "q", 5, 3)], [("a", "y", 3 * day, 4), ("late", "x", 3 * day, 5)], [("late", "w", 20, 6), ("a", "z", 3 * day + 5, 7), ("end", "x", 9 * day, 8)]]
    assert batches(spark, parts, late="1 hour", keep_days=2)[-1] == [("p", "q", 5.0), ("y", "z", 3.0 * day + 5)]
    assert ("x", "y", 3.0 * day) in batches(spark, parts, late="1 hour", keep_days=4)[-1]


def test_state_is_kept_by_buckets_of_sessions_and_whole_numbers_stay_exact(spark, monkeypatch):
    """300 sessions are as many keys of state as there are buckets; items above 2^53 beside a null, and a session's name of that size, are exact."""
    monkeypatch.setattr(ordered, "BUCKETS", 4, raising=False)
    big, path = 2**53 + 1, tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(big + s, item, second, n) for s in range(300) for n, (item, second) in enumerate([(big + 2, 30), (big + s % 2, 20), (None, 10), (big, 5)])] + [(None, 1, 90_000, 0)]
    spark.createDataFrame(rows, "session_id long, item long, second long, seq long").withColumn("ts", F.timestamp_seconds("second")).drop("second").repartition(2).write.parquet(f"{path}/in0")
    src = spark.readStream.schema("session_id long, item long, seq long, ts timestamp").parquet(f"{path}/in*")
    with ordered.row_store(spark):
        told = ordered.ordered_transitions(src).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        told.awaitTermination()
    got = spark.read.schema("from_id long, to_id long, seen timestamp").parquet(f"{path}/out").groupBy("from_id", "to_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(big, big + 2, 150), (big + 1, big + 2, 150)]
    assert max(o.numRowsTotal for p in told.recentProgress for o in p.stateOperators) <= 4 * 10

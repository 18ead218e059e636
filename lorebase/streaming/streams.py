"""Streaming forms: the same columns and aggregates on unbounded input."""

from __future__ import annotations

import json

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorebase.functions import text as tx
from lorebase.operators import extract as ex
from lorebase.operators import memory, sequences
from lorebase.sources.tables import spread
from lorebase.streaming.snapshots import Snapshots


def stream_logs(src: DataFrame) -> DataFrame:
    """Valid log rows with secrets taken out and the day to partition by."""
    valid = memory.validate(src).filter("reject_reason IS NULL").drop("reject_reason")
    return valid.withColumn("content", tx.redact(F.col("content"))).withColumn("day", F.to_date("ts"))


def stream_counts(src: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by key over tumbling or sliding windows; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return src.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def stream_dedup(src: DataFrame, late: str = "7 days") -> DataFrame:
    return src.withColumn("content_hash", F.sha2("content", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def stream_sessions(src: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    window = F.session_window("ts", gap)
    return src.withWatermark("ts", late).groupBy(window.alias("w"), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_transitions(src: DataFrame, timeout_ms: int = 7 * 86_400_000) -> DataFrame:
    """Consecutive different items of each session (session_id, item, ts, seq); the last item is the key's state.

    A task holds a session's rows of one micro-batch, so the source's rate must be limited; write_transitions needs no limit.
    """

    def run(key: tuple, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
        last = state.get[0] if state.exists else None
        out = []
        for item, ts in zip(rows["item"], rows["ts"], strict=True):
            if last is not None and last != item:
                out.append((last, item, ts))
            last = item
        state.update((last,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["from_id", "to_id", "seen"])

    return src.groupBy("session_id").applyInPandasWithState(run, "from_id string, to_id string, seen timestamp", "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_transitions(src: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes of each micro-batch the counts of its transitions and each session's first and last item.

    All stands under the batch's id, so a retry replaces it; stitched_transitions puts the batches together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        order = F.struct("ts", "seq")
        ends = batch.groupBy("session_id").agg(F.min_by("item", order).alias("first"), F.min("ts").alias("first_ts"), F.max_by("item", order).alias("last"))
        sequences.transitions(batch).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch_id}")
        ends.write.mode("overwrite").parquet(f"{path}/ends/batch={batch_id}")

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stitched_transitions(spark: SparkSession, path: str) -> DataFrame:
    """from_id, to_id, count, last_seen of all batches, in which a session's batches follow each other."""
    later = Window.partitionBy("session_id").orderBy("batch")
    ends = spark.read.parquet(f"{path}/ends").select(F.col("last").alias("from_id"), F.lead("first").over(later).alias("to_id"), F.lit(1).cast("long").alias("count"), F.lead("first_ts").over(later).alias("last_seen"))
    pairs = spark.read.parquet(f"{path}/pairs").drop("batch").unionByName(ends.filter("to_id IS NOT NULL AND from_id <> to_id"))
    return pairs.groupBy("from_id", "to_id").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


def stream_attribution(injections: DataFrame, responses: DataFrame, mem: DataFrame, hours: int = 24, lanes: int = 4) -> DataFrame:
    """(memory_id, response_id) of responses to injections of the hours before in their session, where a token of the memory occurs.

    Times are cut into buckets of the window's length. A session's bucket keeps, until the watermark passes it, its memories' tokens
    and its responses, dealt over lanes by their ids; new responses meet all memories there, and earlier responses the new ones,
    by an automaton of the tokens, so no text moves with each pair. A memory that is injected again may be told again.
    """
    micros = hours * 3_600_000_000
    us = lambda c: F.unix_micros(c).alias("us")
    tokens = mem.select(F.col("id").alias("memory_id"), F.array_join(F.transform(tx.distinctive_tokens(F.col("content")), F.lower), "\n").alias("body")).filter("body <> ''")
    bucket = F.floor(F.unix_micros("injected_at") / micros)
    told = injections.withWatermark("injected_at", "1 hour").withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("lane", F.explode(F.array(*map(F.lit, range(lanes)))))
    told = told.join(tokens, "memory_id").select("session_id", "bucket", "lane", F.lit(0).alias("side"), F.col("memory_id").cast("long").alias("id"), us("injected_at"), F.col("injected_at").alias("at"), "body")
    heard = responses.withWatermark("ts", "1 hour").withColumn("bucket", F.floor(F.unix_micros("ts") / micros)).withColumn("lane", F.pmod(F.xxhash64("response_id"), F.lit(lanes)).cast("int"))
    heard = heard.select("session_id", "bucket", "lane", F.lit(1).alias("side"), F.col("response_id").cast("long").alias("id"), us("ts"), F.col("ts").alias("at"), F.lower("text").alias("body"))

    def pairs(told: list, heard: list) -> set:
        users, automaton = {}, ahocorasick.Automaton()
        for memory, us, body in told:
            for token in body.split("\n"):
                users.setdefault(token, []).append((memory, us))
        for token, own in users.items():
            automaton.add_word(token, own)
        automaton.make_automaton()
        return {(memory, response) for response, us, text in (heard if users else ()) for own in {id(o): o for _, o in automaton.iter(text)}.values() for memory, at in own if 0 <= us - at <= micros}

    def run(key: tuple, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        old_told, old_heard = (json.loads(x) for x in state.get) if state.exists else ([], [])
        told, heard = [], []
        for pdf in pdfs:
            for side, *row in zip(pdf["side"], pdf["id"].tolist(), pdf["us"].tolist(), pdf["body"], strict=True):
                (heard if side else told).append(row)
        found = pairs(old_told + told, heard) | pairs(told, old_heard)
        state.update((json.dumps(old_told + told), json.dumps(old_heard + heard)))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * micros // 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(sorted(found), columns=["memory_id", "response_id"])

    rows = told.unionByName(heard).filter("session_id IS NOT NULL AND us IS NOT NULL AND body IS NOT NULL")
    return rows.groupBy("session_id", "bucket", "lane").applyInPandasWithState(run, "memory_id long, response_id long", "told string, heard string", "append", GroupStateTimeout.EventTimeTimeout)


#: Logs of a micro-batch that a task takes, however few files they come in.
BATCH_A_TASK = 100_000


def mined_state(spark: SparkSession, path: str, every: int = 16) -> Snapshots:
    return Snapshots(spark, path, lambda rows: ex.merge_patterns(rows.limit(0), rows), every)


def stream_mining(src: DataFrame, state_path: str, checkpoint: str, kinds: list[str] | None = None):
    """Starts a query that adds each micro-batch's partial aggregates to the state (mined_state reads it)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        mined_state(batch.sparkSession, state_path).write(ex.aggregate_patterns(ex.extract_all(spread(batch, BATCH_A_TASK), kinds)), batch_id)

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def copies_state(spark: SparkSession, path: str, every: int = 16) -> Snapshots:
    return Snapshots(spark, path, lambda rows: rows.groupBy("content_hash").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")), every)


def stream_copies(src: DataFrame, state_path: str, checkpoint: str):
    """Starts a query that counts all copies of each content, the later ones that stream_dedup leaves out too (copies_state reads it)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        copies_state(batch.sparkSession, state_path).write(own, batch_id)

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

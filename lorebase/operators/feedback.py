"""What was retrieved, injected and used."""

from __future__ import annotations

from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import scores
from lorebase.functions import text as tx


def since(df: DataFrame, ts: str, as_of: Column, days: float) -> DataFrame:
    return df.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {int(days * 86400)} SECONDS"))


def retrieval_events(ranked: DataFrame, as_of: Column) -> DataFrame:
    """The log rows of a recall, one per query and result: event_id, query_key, memory_id, similarity, was_used, created_at."""
    key = F.sha2(F.col("query_id").cast("string"), 256)
    return ranked.select(F.xxhash64("query_id", "id", as_of).alias("event_id"), key.alias("query_key"), F.col("id").alias("memory_id"), "similarity", F.lit(False).alias("was_used"), as_of.alias("created_at"))


def mark_used(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks rows of (memory, query) as used; a mark without a query takes the memory's latest row."""
    keyed = marks.filter("query_key IS NOT NULL").select("memory_id", "query_key").distinct().withColumn("m1", F.lit(True))
    latest = events.groupBy("memory_id").agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("event_id"))
    loose = marks.filter("query_key IS NULL").select("memory_id").distinct().join(latest, "memory_id").select("event_id", F.lit(True).alias("m2"))
    out = events.join(keyed, ["memory_id", "query_key"], "left").join(loose, "event_id", "left")
    return out.withColumn("was_used", F.col("was_used") | F.coalesce("m1", "m2", F.lit(False))).drop("m1", "m2")


def usage_counts(events: DataFrame) -> DataFrame:
    """Counters derived from events, each retrieval once."""
    out = events.groupBy("memory_id").agg(F.count("*").alias("retrieved_count"), F.sum(F.col("was_used").cast("long")).alias("used_count"), F.max(F.when(F.col("was_used"), F.col("created_at"))).alias("last_used_at"))
    return out.withColumn("utility_score", scores.helpfulness(F.col("used_count"), F.col("retrieved_count")))


def retrieval_stats(events: DataFrame, as_of: Column, days: int = 30, by: str | None = None) -> DataFrame:
    """Totals, use rate and mean similarities of a window, overall or by a column."""
    rows = since(events, "created_at", as_of, days)
    used = F.col("was_used")
    return rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("total"), F.sum(used.cast("long")).alias("used"), F.round(F.avg(used.cast("double")), 6).alias("use_rate"),
        F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.round(F.avg(F.when(used, F.col("similarity"))), 6).alias("avg_similarity_used"),
        F.countDistinct("memory_id").alias("n_memories"), F.countDistinct("query_key").alias("n_queries"),
    )


def least_useful(events: DataFrame, as_of: Column, days: int = 30, min_count: int = 3, limit: int = 5) -> DataFrame:
    rows = since(events, "created_at", as_of, days).groupBy("memory_id").agg(F.count("*").alias("n"), F.sum(F.col("was_used").cast("long")).alias("used"))
    return rows.filter(f"n >= {min_count} AND used = 0").orderBy(F.desc("n"), "memory_id").limit(limit)


def recent_recalls(events: DataFrame, limit: int = 5) -> DataFrame:
    return events.filter("was_used").groupBy("memory_id").agg(F.max("created_at").alias("used_at")).orderBy(F.desc("used_at"), "memory_id").limit(limit)


def recent_injections(log: DataFrame, mem: DataFrame, as_of: Column, days: int = 7, resource: str | None = None, limit: int = 50) -> DataFrame:
    rows = since(log, "injected_at", as_of, days)
    if resource is not None:
        rows = rows.filter(F.col("resource") == resource)
    top = rows.orderBy(F.desc("injected_at"), "memory_id", "session_id").limit(limit)
    return top.join(mem.select(F.col("id").alias("memory_id"), F.substring("content", 1, 100).alias("preview")), "memory_id", "left")


def was_injected(mem: DataFrame, log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    counts = since(log, "injected_at", as_of, days).groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    return mem.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("was_injected"))


def injection_stats(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    rows = since(log, "injected_at", as_of, days)
    today = F.col("injected_at") >= F.date_trunc("day", as_of)
    return rows.groupBy("resource").agg(F.count("*").alias("total"), F.countDistinct("memory_id").alias("n_memories"), F.sum(today.cast("long")).alias("today"))


def injection_value(log: DataFrame, mem: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """id, n, and which of high_value, low_utility and candidate hold."""
    counts = since(log, "injected_at", as_of, days).groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    rows = counts.join(mem.select("id", "used_count", "utility_score", "is_hot"), "id")
    return rows.withColumns({"high_value": (F.col("n") >= 3) & (F.col("used_count") > 0), "low_utility": (F.col("n") >= 5) & (F.col("used_count") == 0), "candidate": ~F.col("is_hot") & (F.col("n") >= 5) & (F.col("utility_score") >= 0.3)})


def feedback_actions(values: DataFrame) -> DataFrame:
    """Candidates are promoted (source feedback), low-utility rows get a warning."""
    promote = values.filter("candidate").select("id", F.lit("promote").alias("action"), F.lit("feedback").alias("source"))
    return promote.unionByName(values.filter("low_utility").select("id", F.lit("warn").alias("action"), F.lit(None).cast("string").alias("source")))


def co_occurrence(log: DataFrame, as_of: Column, band_seconds: float = 60.48, min_count: int = 3, days: int = 7) -> DataFrame:
    """Pairs of different memories injected into the same resource within the band.

    Times are cut into buckets of the band's length; a row meets its own and the next bucket, so the
    join is an equality join, and the exact difference is checked on the rest.
    """
    micros = int(band_seconds * 1_000_000)
    rows = since(log, "injected_at", as_of, days).select("memory_id", "resource", F.unix_micros(F.col("injected_at").cast("timestamp")).alias("t"))
    bucket = F.floor(F.col("t") / micros).cast("long")
    left = rows.select("resource", F.col("memory_id").alias("a"), F.col("t").alias("ta"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    right = rows.select("resource", F.col("memory_id").alias("b"), F.col("t").alias("tb"), bucket.alias("bucket"))
    pairs = left.join(right, ["resource", "bucket"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < micros))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def attribute_usage(injections: DataFrame, mem: DataFrame, responses: DataFrame, hours: int = 24, session: bool = True, block: int = 4096) -> DataFrame:
    """(memory_id, response_id) where a distinctive token of an injected memory occurs in a later response, of its session or of any.

    injections: memory_id, session_id, injected_at; responses: response_id, session_id, ts, text. Times are cut into buckets of the
    window's length. The memories of a session and bucket, at most about block of them, make one automaton of their tokens, which runs
    once over each response. Larger ones are dealt over several automata, and their responses over several tasks.
    """
    keys = ["session_id"] * session
    micros = hours * 3_600_000_000
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    told = injections.select("memory_id", *keys, at("injected_at").alias("t")).dropna().withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / micros), F.floor(F.col("t") / micros) + 1)))
    told = told.groupBy(*keys, "bucket", "memory_id").agg(F.collect_set("t").alias("times"))
    tokens = mem.select(F.col("id").alias("memory_id"), F.transform(tx.distinctive_tokens(F.col("content")), F.lower).alias("tokens")).filter(F.size("tokens") > 0)
    heard = responses.select("response_id", *keys, at("ts").alias("s"), F.lower("text").alias("text")).dropna().withColumn("bucket", F.floor(F.col("s") / micros))
    dealt = told.groupBy(*keys, "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("i_of")).join(heard.groupBy(*keys, "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("j_of")), [*keys, "bucket"])
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = told.join(dealt, [*keys, "bucket"]).join(tokens, "memory_id").withColumn("j", F.explode(to("j_of"))).withColumn("i", F.pmod(F.xxhash64("memory_id"), F.col("i_of")).cast("int"))
    right = heard.join(dealt, [*keys, "bucket"]).withColumn("i", F.explode(to("i_of"))).withColumn("j", F.pmod(F.xxhash64("response_id"), F.col("j_of")).cast("int"))
    group = F.to_json(F.struct(*keys, "bucket", "i", "j")).alias("group")
    left = left.select(group, F.lit(0).alias("side"), F.col("memory_id").cast("long").alias("id"), "times", "tokens", F.lit(None).cast("string").alias("text"))
    right = right.select(group, F.lit(1).alias("side"), F.col("response_id").cast("long").alias("id"), F.array("s").alias("times"), F.lit(None).cast("array<string>").alias("tokens"), "text")

    def run(batches):
        key, users, automaton = None, {}, None
        for batch in batches:
            found = []
            for group, side, i, times, tokens, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != key:
                    key, users, automaton = group, {}, None
                if side == 0:
                    for token in tokens:
                        users.setdefault(token, []).append((i, sorted(times)))
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for token, own in users.items():
                        automaton.add_word(token, own)
                    automaton.make_automaton()
                hits = {memory: ts for _, own in (automaton.iter(text) if users else ()) for memory, ts in own}
                for memory, ts in hits.items():
                    after = bisect_right(ts, times[0])
                    if after and times[0] - ts[after - 1] <= micros:
                        found.append((memory, i))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["memory_id", "response_id"])

    tasks = int(mem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(tasks, "group").sortWithinPartitions("group", "side").mapInArrow(run, "memory_id long, response_id long").distinct()


def cross_session(log: DataFrame, mem: DataFrame, min_sessions: int = 2, limit: int = 50) -> DataFrame:
    counts = log.filter("session_id IS NOT NULL").groupBy(F.col("memory_id").alias("id")).agg(F.countDistinct("session_id").alias("n_sessions"), F.array_join(F.transform(F.array_sort(F.collect_set("session_id")), lambda x: x.cast("string")), ",").alias("sessions"))
    rows = counts.filter(F.col("n_sessions") >= min_sessions).join(mem.select("id", "access_count", F.substring("content", 1, 200).alias("preview")), "id")
    return rows.orderBy(F.desc("n_sessions"), F.desc("access_count"), "id").limit(limit)

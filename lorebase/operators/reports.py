"""Aggregates over the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(mem: DataFrame, digits: int = 2) -> DataFrame:
    """Counts in total and by type, source and category, in one pass over grouping sets."""
    rows = mem.select("memory_type", "source", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.col("is_hot").cast("long").alias("hot"), "access_count", "trust_score")
    measures = [F.count("*").alias("n"), F.sum("hot").alias("n_hot"), F.sum("access_count").alias("accesses"), F.round(F.avg("trust_score"), digits).alias("avg_trust"), F.grouping_id().alias("g")]
    return rows.groupingSets([[], ["memory_type"], ["source"], ["category"]], "memory_type", "source", "category").agg(*measures).drop("g")


def daily(df: DataFrame, ts: str, as_of: Column, days: int = 30, hot: str | None = None) -> DataFrame:
    rows = df.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {days} DAYS"))
    flag = F.col(hot).cast("long") if hot else F.lit(0)
    return rows.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum(flag).alias("n_hot"))


def op_metrics(recalls: DataFrame, mem: DataFrame, capacity: int = 10) -> DataFrame:
    """Counters and gauges as (metric, value) rows. recalls: query_key, memory_id, was_used."""
    counters = recalls.agg(F.countDistinct("query_key").alias("recall_total"), F.count("*").alias("recall_returned"), F.sum(F.col("was_used").cast("long")).alias("recall_used"))
    gauges = mem.agg(F.sum(F.col("is_hot").cast("long")).alias("hot_size"), F.sum(F.col("is_pinned").cast("long")).alias("hot_pinned"), F.sum((F.col("source") == "mined").cast("long")).alias("store_mined"))
    one = counters.crossJoin(gauges)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one.columns])).alias("m")).select("m.*")


def loop_health(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """red: the last three runs failed; amber: no success within so many days; else green."""
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(3).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rows = runs.agg(F.max(F.when(~F.col("failed"), F.col("started_at"))).alias("last_success"), F.sum((~F.col("failed") & (F.col("started_at") > as_of - F.expr(f"INTERVAL {days} DAYS"))).cast("long")).alias("recent_successes"), F.sum(F.when(~F.col("failed") & (F.col("started_at") > as_of - F.expr(f"INTERVAL {days} DAYS")), F.col("n_patterns"))).alias("recent_patterns"))
    old = F.col("last_success").isNull() | (F.col("last_success") < as_of - F.expr(f"INTERVAL {days * 86400} SECONDS"))
    state = F.when((F.col("n") == 3) & (F.col("failures") == 3), "red").when(old, "amber").otherwise("green")
    return rows.crossJoin(last).select(state.alias("state"), "recent_successes", F.coalesce("recent_patterns", F.lit(0)).alias("recent_patterns"))  # one row each

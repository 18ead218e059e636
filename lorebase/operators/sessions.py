"""Sessions: rollup, overview, summary by theme and what is kept at their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import scores

# Category -> theme; the rest is context.
THEMES = {"decisions": ["decision", "architecture", "constraint"], "insights": ["lesson", "antipattern", "landmine", "observation"], "actions": ["todo", "bug", "workflow"]}


def sessions(mem: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per session over memories (created_at) and logs (ts)."""
    parts = mem.select("session_id", F.col("created_at").alias("ts"), F.lit(1).alias("m"), F.lit(0).alias("l"), "project_id").unionByName(logs.select("session_id", "ts", F.lit(0).alias("m"), F.lit(1).alias("l"), "project_id"))
    first = F.min_by("project_id", F.when(F.col("project_id").isNotNull(), F.struct("ts", "project_id")))
    return parts.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_activity"), F.sum("m").alias("memory_count"), F.sum("l").alias("log_count"), first.alias("project_path"))


def recent_sessions(rolled: DataFrame, topics: DataFrame | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
    if path is not None:
        rolled = rolled.filter(F.col("project_path") == path)
    top = rolled.orderBy(F.desc("last_activity"), "session_id").limit(limit)
    return top.join(topics, "session_id", "left") if topics is not None else top


def session_items(mem: DataFrame, tags: DataFrame, limit: int = 100) -> DataFrame:
    """Each session's newest rows with their tags joined."""
    joined = tags.groupBy(F.col("memory_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), "id"))
    return mem.withColumn("rank", rank).filter(F.col("rank") <= limit).join(joined, "id", "left")


def session_overview(rolled: DataFrame, mem: DataFrame) -> DataFrame:
    counts = mem.groupBy("session_id").agg(F.count("*").alias("n_items"), F.sum(F.col("is_hot").cast("long")).alias("n_hot"))
    return rolled.join(counts, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_items", "n_hot")})


def theme(category: Column) -> Column:
    out = F.lit("context")
    for name, categories in THEMES.items():
        out = F.when(category.isin(categories), name).otherwise(out)
    return out


def summarize_sessions(mem: DataFrame, limit: int = 20) -> DataFrame:
    """The most important rows of each session and theme, for all sessions at once."""
    rows = mem.withColumn("theme", theme(F.col("category")))
    rank = F.row_number().over(Window.partitionBy("session_id", "theme").orderBy(F.desc("importance_score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("session_id", "theme", "rank", "id")


def end_sessions(mem: DataFrame, as_of: Column, most: int = 3, threshold: float = 0.6) -> DataFrame:
    """Episodic rows that outlive their session: the most salient ones over the threshold."""
    salience = scores.salience(F.col("importance_score"), F.col("trust_score"), F.col("access_count"), F.col("last_accessed_at"), as_of)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("salience"), "id"))
    rows = mem.filter("memory_type = 'episodic'").withColumn("salience", salience).withColumn("rank", rank)
    return rows.filter((F.col("rank") <= most) & (F.col("salience") >= threshold)).select("session_id", "id", "salience", F.lit("project").alias("memory_type"), F.lit("session_end").alias("promotion_source"))

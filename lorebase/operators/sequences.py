"""First-order access sequences: what follows what, with which probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a session that one task puts in order.
SESSION_PART = 1 << 20


def transitions(log: DataFrame, session: str = "session_id", item: str = "item", ts: str = "ts", seq: str = "seq", part: int | None = None) -> DataFrame:
    """Consecutive different items of a session: from_id, to_id, count, last_seen. One shuffle by session, one by pair.

    A session with more than part rows is cut into ranges of time, and each range's last row is followed by the first row of
    the session's next range. Ranges are equally long, so rows that all have one time stay together. Rows without a session are one session.
    """
    part = part or SESSION_PART
    rows = log.select(F.col(session).alias("s"), F.col(item).alias("item"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    hot = rows.groupBy("s").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most")).filter(F.col("n") > part)
    hot = hot.select(F.col("s").alias("hot"), "least", ((F.col("most") - F.col("least") + 1) / F.ceil(F.col("n") / part)).alias("width"))
    rows = rows.join(hot, F.col("s").eqNullSafe(F.col("hot")), "left").withColumn("range", F.coalesce(F.floor((F.col("at") - F.col("least")) / F.col("width")), F.lit(0)))
    order = Window.partitionBy("s", "range").orderBy("ts", "seq")
    pairs = rows.select("s", "range", F.col("item").alias("from_id"), F.lead("item").over(order).alias("to_id"), F.lead("ts").over(order).alias("seen"))
    inside = pairs.filter("seen IS NOT NULL").select("from_id", "to_id", "seen")
    # Of the ranges of hot sessions only their first and last rows meet: a row each for part rows of the log.
    cut = rows.filter("width IS NOT NULL").groupBy("s", "range").agg(F.min_by(F.struct("item", "ts"), F.struct("ts", "seq")).alias("first"), F.max_by(F.struct("item", "ts"), F.struct("ts", "seq")).alias("last"))
    later = Window.partitionBy("s").orderBy("range")
    over = cut.select(F.col("last.item").alias("from_id"), F.lead("first.item").over(later).alias("to_id"), F.lead("first.ts").over(later).alias("seen")).filter("seen IS NOT NULL")
    found = inside.unionByName(over).filter("to_id IS NOT NULL AND from_id <> to_id")
    return found.groupBy("from_id", "to_id").agg(F.count("*").alias("count"), F.max("seen").alias("last_seen"))


def result_log(ranked: DataFrame, as_of: Column) -> DataFrame:
    """Ranked results as a log for transitions: each result is followed by the next one of its query."""
    return ranked.select(F.col("query_id").alias("session_id"), F.col("id").alias("item"), as_of.alias("ts"), F.col("rank").alias("seq"))


def probabilities(trans: DataFrame) -> DataFrame:
    return trans.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from_id")))


def access_patterns(trans: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent followers of each item, at most limit."""
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("count"), "to_id"))
    return probabilities(trans).withColumn("rank", rank).filter(F.col("rank") <= limit)


def predict_next(trans: DataFrame, targets: DataFrame | None = None, threshold: float = 0.3, limit: int = 3) -> DataFrame:
    """Likely followers of each item: of the first 2 * limit those with enough probability and an existing target."""
    out = access_patterns(trans, 2 * limit).filter(F.col("probability") >= threshold)
    if targets is not None:
        out = out.join(targets.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("count"), "to_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit).select("from_id", "to_id", "count", "probability", "rank")


def all_patterns(trans: DataFrame, min_count: int = 2, limit: int = 50) -> DataFrame:
    """The most frequent pairs; probabilities count rare pairs too."""
    return probabilities(trans).filter(F.col("count") >= min_count).orderBy(F.desc("count"), "from_id", "to_id").limit(limit)


def sequence_stats(trans: DataFrame) -> DataFrame:
    return trans.agg(F.count("*").alias("patterns"), F.countDistinct("from_id").alias("sources"), F.coalesce(F.sum("count"), F.lit(0)).alias("transitions"))


def decay(trans: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Counts of pairs not seen for so many days are halved; pairs at zero go."""
    old = F.col("last_seen") < as_of - F.expr(f"INTERVAL {days} DAYS")
    return trans.withColumn("count", F.when(old, F.floor(F.col("count") / 2)).otherwise(F.col("count")).cast("long")).filter("count > 0")


def warm(memories: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted memories that are not hot yet: id, promotion_source."""
    ids = predictions.select(F.col("to_id").alias("id")).distinct()
    return memories.filter(~F.col("is_hot")).join(ids, "id", "left_semi").select("id", F.lit("predicted").alias("promotion_source"))

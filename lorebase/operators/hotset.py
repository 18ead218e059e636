"""Promotion, capacity-bound selection, demotion and retention of the hot set; trust ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import rules, scores
from lorebase.functions import text as tx
from lorebase.sources.shared import cut


def _ago(as_of: Column, days) -> Column:
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def promotion_decisions(mem: DataFrame, as_of: Column, salience_threshold: float = 0.5, access_threshold: int = 3, min_helpfulness: float = 0.20) -> DataFrame:
    """id, decision (promote, reject or none), reason, pin: the first rule that applies."""
    salience = scores.salience(F.coalesce("importance_score", F.lit(0.5)), F.coalesce("trust_score", F.lit(1.0)), F.col("access_count"), F.col("last_accessed_at"), as_of)
    eager = (salience >= tx.promotion_threshold(F.col("category"), salience_threshold)) | (F.col("access_count") >= access_threshold)
    useless = (F.col("retrieved_count") >= 3) & (scores.helpfulness(F.col("used_count"), F.col("retrieved_count")) < min_helpfulness)
    reason = F.when(F.col("is_hot"), "already_hot").when(~tx.promotable(F.col("category")), "category_ineligible").when(~eager, "threshold_not_met").when(useless, "low_helpfulness").otherwise("auto_threshold")
    decision = F.when(F.col("reason") == "auto_threshold", "promote").when(F.col("reason") == "already_hot", "none").otherwise("reject")
    pin = (F.col("reason") == "auto_threshold") & tx.auto_pin(F.col("category"), F.coalesce("trust_score", F.lit(1.0)))
    return mem.withColumn("reason", reason).select("id", decision.alias("decision"), "reason", pin.alias("pin"))


def select_hot(mem: DataFrame, as_of: Column, capacity: int = 10, partition: str | None = None) -> DataFrame:
    """Pinned rows stay; others fill the capacity by hot score. Adds hot_score and kept."""
    scored = mem.filter("is_hot").withColumn("hot_score", scores.hot_score(F.col("access_count"), F.col("last_accessed_at"), as_of))
    order = [F.desc("is_pinned"), F.desc("hot_score"), F.col("id")]
    if partition is None:  # the first rows suffice: no global window
        first = scored.orderBy(*order).limit(capacity).select("id", F.lit(True).alias("first"))
        return scored.join(first, "id", "left").withColumn("kept", F.col("is_pinned") | F.coalesce("first", F.lit(False))).drop("first")
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return scored.withColumn("kept", F.col("is_pinned") | (rank <= capacity))


def order_hot(mem: DataFrame, as_of: Column) -> DataFrame:
    """Hot rows with their order keys, most recently used first."""
    trust = scores.trust_decayed(F.coalesce("trust_score", F.lit(1.0)), F.col("created_at"), F.col("last_accessed_at"), F.col("memory_type"), F.col("access_count"), as_of)
    ratio = F.when(F.col("access_count") > 0, F.col("used_count") / F.col("access_count")).otherwise(0.0)
    out = mem.filter("is_hot").withColumns({"trust_now": trust, "use_ratio": ratio})
    return out.orderBy(F.desc_nulls_last("last_used_at"), F.desc("trust_now"), F.desc("use_ratio"), "id")


def stale_hot(mem: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Hot unpinned rows idle for so many whole days, by how lasting their category is."""
    idle = F.floor(tx.days_between(F.coalesce("last_accessed_at", "created_at"), as_of)).cast("long")
    limit = F.floor(days * tx.scope_factor(F.col("category"))).cast("long")
    return mem.filter("is_hot AND NOT is_pinned").withColumns({"idle_days": idle, "limit_days": limit}).filter("idle_days >= limit_days")


def apply_actions(mem: DataFrame, actions: DataFrame) -> DataFrame:
    """The latest of pin, unpin, promote, demote per id takes effect; only hot rows are pinned, demoting unpins."""
    last = actions.groupBy("id").agg(F.max_by("action", "seq").alias("action"))
    hot = F.when(F.col("action") == "promote", True).when(F.col("action") == "demote", False).otherwise(F.col("is_hot"))
    pinned = F.when(F.col("action") == "pin", F.col("is_hot")).when(F.col("action").isin("unpin", "demote"), False).otherwise(F.col("is_pinned"))
    return mem.join(last, "id", "left").withColumns({"is_hot": hot, "is_pinned": pinned}).drop("action")


def hot_context(mem: DataFrame, recent: DataFrame, predictions: DataFrame, as_of: Column, capacity: int = 10) -> DataFrame:
    """Recently used recalls, then predictions, then promoted rows by salience: the first of each id, capacity rows.

    recent: id, ord; predictions: id, ord. The sources are top-k lists, so the final order is small.
    """
    salience = scores.salience(F.col("importance_score"), F.col("trust_score"), F.col("access_count"), F.col("last_accessed_at"), as_of)
    promoted = mem.filter("is_hot").select("id", salience.alias("s")).orderBy(F.desc("s"), "id").limit(capacity + 100)
    promoted = promoted.select("id", F.lit(3).alias("priority"), (-F.col("s")).alias("ord"))
    parts = recent.select("id", F.lit(1).alias("priority"), F.col("ord").cast("double").alias("ord")).unionByName(predictions.select("id", F.lit(2).alias("priority"), F.col("ord").cast("double").alias("ord"))).unionByName(promoted)
    first = parts.groupBy("id").agg(F.min(F.struct("priority", "ord")).alias("m"))
    return first.select("id", "m.priority", "m.ord").orderBy("priority", "ord", "id").limit(capacity)


def retention(mem: DataFrame, as_of: Column) -> DataFrame:
    """Rows past their kind's retention: not hot, and neither accessed nor created since."""
    days = tx.choose(F.col("memory_type"), rules.RETENTION_DAYS, 0)
    old = tx.days_between(F.coalesce("last_accessed_at", "created_at"), as_of) > days
    return mem.filter((days > 0) & ~F.col("is_hot") & old & (tx.days_between(F.col("created_at"), as_of) > days))


def suggest(results: DataFrame, min_access: int = 3, most: int = 2) -> DataFrame:
    """Per query the first cold results with many accesses."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return results.filter(~F.col("is_hot") & (F.col("access_count") >= min_access)).withColumn("n", rank).filter(F.col("n") <= most).drop("n")


def hot_metrics(mem: DataFrame, as_of: Column) -> DataFrame:
    score = scores.hot_score(F.col("access_count"), F.col("last_accessed_at"), as_of)
    free = F.when(~F.col("is_pinned"), F.struct("access_count", (-F.col("id")).alias("i")))
    return mem.filter("is_hot").agg(
        F.count("*").alias("n_hot"), F.sum(F.col("is_pinned").cast("long")).alias("n_pinned"), F.round(F.avg(score), 6).alias("avg_hot_score"),
        F.max_by("id", F.struct("access_count", (-F.col("id")).alias("i"))).alias("most_accessed"), F.min_by("id", F.when(~F.col("is_pinned"), F.struct("access_count", F.col("id").alias("i")))).alias("least_accessed"),
    )


def decay_unused(mem: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Mined rows that were never retrieved or used, old and still hot or useful: they lose both."""
    hit = (F.col("source") == "mined") & ~F.col("is_pinned") & (F.col("retrieved_count") == 0) & (F.col("used_count") == 0) & (F.col("created_at") < _ago(as_of, days)) & (F.col("is_hot") | (F.col("utility_score") > 0))
    return mem.withColumn("decayed", hit).withColumns({"is_hot": F.col("is_hot") & ~hit, "utility_score": F.when(hit, 0.0).otherwise(F.col("utility_score"))})


def trust_deltas(events: DataFrame) -> DataFrame:
    """Adds delta: the reason's change, gains scaled by similarity."""
    base = tx.choose(F.col("reason"), rules.TRUST_CHANGE, 0.0)
    return events.withColumn("delta", F.when((base > 0) & F.col("similarity").isNotNull(), base * (0.5 + 0.5 * F.col("similarity"))).otherwise(base))


#: Trust events of one memory that are folded as one list.
BLOCK = 4096


def _in_blocks(events: DataFrame) -> DataFrame:
    """memory_id, block, seq, delta: BLOCK events of a memory are a block, by their running number within the memory.

    The numbers come in two passes: events are dealt by ranges of memory and seq, numbered within a range, and a memory's
    ranges before it are counted. So no task sorts more than a range of a memory with very many events.
    """
    rows = trust_deltas(events).select("memory_id", F.col("seq").cast("bigint").alias("seq"), "delta")
    dealt = cut(rows.repartitionByRange("memory_id", "seq", "delta").withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("memory_id", "range").agg(F.count("*").alias("n"))
    before = counts.select("memory_id", "range", (F.sum("n").over(Window.partitionBy("memory_id").orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("memory_id", "range").orderBy("seq", "delta")) - 1
    numbered = dealt.withColumn("place", place).join(before, ["memory_id", "range"])
    return numbered.select("memory_id", F.floor((F.col("place") + F.col("before")) / BLOCK).cast("int").alias("block"), "seq", "delta")


def _clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _folded(base: DataFrame, rows: DataFrame) -> DataFrame:
    """memory_id, start, blocks in order. A run of clamped additions is one: least(high, greatest(low, x + shift)).

    value: the trust that the block gives from the start, step by step; the first block uses it, so a memory of one
    block has the very digits of a sequential fold.
    """
    starts = base.select(F.col("id").alias("memory_id"), F.coalesce(F.col("trust_score"), F.lit(1.0)).cast("double").alias("start"))
    none = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.col("start").alias("value"))
    then = lambda f, x: F.struct((f.shift + x.delta).alias("shift"), _clamped(f.low + x.delta).alias("low"), _clamped(f.high + x.delta).alias("high"), _clamped(f.value + x.delta).alias("value"))
    blocks = rows.groupBy("memory_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("steps")).join(starts, "memory_id")
    blocks = blocks.select("memory_id", "start", "block", F.size("steps").alias("n"), F.aggregate("steps", none, then).alias("f"))
    return blocks.groupBy("memory_id", "start").agg(F.array_sort(F.collect_list(F.struct("block", "n", "f"))).alias("blocks"))


def _after(trust: Column, f: Column) -> Column:
    """A null trust stands before the first block."""
    return F.when(trust.isNull(), f["value"]).otherwise(F.least(f["high"], F.greatest(f["low"], trust + f["shift"])))


def last_trust(base: DataFrame, events: DataFrame) -> DataFrame:
    """Trust of each memory after its events in order, within 0 and 1 after each: memory_id, trust, n_steps.

    Events of one memory are folded in parallel by blocks of BLOCK; only one row per block meets in a task.
    """
    n = F.aggregate("blocks", F.lit(0), lambda acc, x: acc + x.n)
    trust = F.aggregate("blocks", F.lit(None).cast("double"), lambda acc, x: _after(acc, x.f))
    return _folded(base, _in_blocks(events)).select("memory_id", trust.alias("trust"), n.alias("n_steps"))


def trust_steps(base: DataFrame, events: DataFrame) -> DataFrame:
    """One row per event: memory_id, seq, old, new; each block starts from the trust that the blocks before it leave."""
    rows = _in_blocks(events)
    seed = F.struct(F.lit(None).cast("double").alias("trust"), F.array().cast("array<struct<block:int,old:double>>").alias("starts"))
    then = lambda acc, x: F.struct(_after(acc.trust, x.f).alias("trust"), F.concat(acc.starts, F.array(F.struct(x.block.alias("block"), F.coalesce(acc.trust, F.col("start")).alias("old")))).alias("starts"))
    starts = _folded(base, rows).select("memory_id", F.explode(F.aggregate("blocks", seed, then).starts).alias("s")).select("memory_id", "s.block", "s.old")
    dealt = rows.join(starts, ["memory_id", "block"]).select("memory_id", "block", "seq", "delta", "old").repartition("memory_id", "block").sortWithinPartitions("memory_id", "block", "seq", "delta")

    def run(pdfs):
        key = trust = None
        for pdf in pdfs:
            before, after = [], []
            for m, b, d, start in zip(pdf.memory_id.tolist(), pdf.block.tolist(), pdf.delta.tolist(), pdf.old.tolist(), strict=True):
                if (m, b) != key:
                    key, trust = (m, b), start
                before.append(trust)
                trust = min(1.0, max(0.0, trust + d))
                after.append(trust)
            yield pdf[["memory_id", "seq"]].assign(old=before, new=after)

    return dealt.mapInPandas(run, "memory_id long, seq long, old double, new double")


def replay_trust(base: DataFrame, events: DataFrame) -> DataFrame:
    """last_trust with trust_steps as an array: memory_id, trust, history. For memories with few events; others take the two apart."""
    history = trust_steps(base, events).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("history"))
    return last_trust(base, events).select("memory_id", "trust").join(history, "memory_id")


def trust_history(events: DataFrame, limit: int = 50) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("ts"), F.desc("seq")))
    return trust_deltas(events).withColumn("rank", rank).filter(F.col("rank") <= limit)


def strengthen(results: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Ledger rows for recall hits of high similarity."""
    return trust_deltas(results.filter(F.col("similarity") >= threshold).withColumn("reason", F.lit("high_similarity_hit")))


def penalize(mem: DataFrame, min_retrieved: int = 5) -> DataFrame:
    """Ledger rows for memories often retrieved and never used."""
    return mem.filter((F.col("retrieved_count") >= min_retrieved) & (F.col("used_count") == 0)).select(F.col("id").alias("memory_id"), F.lit("low_utility").alias("reason"), F.lit(rules.TRUST_CHANGE["low_utility"]).alias("delta"))

"""Jobs that run several operators in order and report counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as tx
from lorebase.operators import extract, feedback, hotset, memory, sequences
from lorebase.sources.shared import cut


def recategorize(mem: DataFrame, every: bool = False, shown: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their new category, counts by changed, first changes) for uncategorised rows, or all."""
    rows = mem if every else mem.filter("category IS NULL")
    new = rows.select("id", "category", tx.category_at_hits(F.col("content")).alias("new_category")).withColumn("changed", ~F.col("category").eqNullSafe(F.col("new_category")))
    return new, new.groupBy("changed").agg(F.count("*").alias("n")), new.filter("changed").orderBy("id").limit(shown)


def run_mining(logs: DataFrame, state: DataFrame | None, as_of: Column, hours: int | None = None, kinds: list[str] | None = None, min_count: int = 3) -> dict[str, DataFrame]:
    """Tables of one mining run: patterns (state after it), admitted memories, frequent patterns, entity links, and its counters.

    Links are between admitted memories of one source log; a memory's id in them is the hash of its text.

    Extraction is narrow; patterns move once, by the hash of their text. A run row with counters comes
    from the written tables, so it does not compute them again.
    """
    chosen = memory.recent_outputs(logs, as_of, hours) if hours is not None else logs
    found = cut(extract.extract_all(chosen, kinds), "found")
    new = cut(extract.aggregate_patterns(found), "patterns")
    patterns = cut(new if state is None else extract.merge_patterns(state, new), "state")
    fresh = new if state is None else new.join(state.select("pattern_hash"), "pattern_hash", "left_anti")
    admitted = extract.admit_patterns(fresh)
    frequent = patterns.filter(F.col("count") >= min_count)
    named = cut(admitted.select(F.sha2("content", 256).alias("id"), "source_log_id", "kind"), "named")
    none = named.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("mentions").alias("relation_type")).limit(0)
    links = cut(extract.entity_links(named, none), "links")
    counts = [("logs", chosen), ("found", found), ("patterns", patterns), ("new_patterns", fresh), ("admitted", admitted), ("frequent", frequent), ("links", links)]
    run = None
    for name, df in counts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        run = row if run is None else run.unionByName(row)
    return {"patterns": patterns, "admitted": admitted, "frequent": frequent, "links": links, "run": run}


def full_cleanup(mem: DataFrame, patterns: DataFrame, logs: DataFrame, trans: DataFrame, injections: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Demotion, expiry, retention, decay and penalties in their fixed order: new tables, ledger rows and a report."""
    stale = hotset.stale_hot(mem, as_of).select("id", F.lit(True).alias("stale"))
    demoted = mem.join(stale, "id", "left").withColumn("is_hot", F.col("is_hot") & F.col("stale").isNull())
    expired = extract.expire(patterns, as_of)
    kept_logs = memory.purge(logs, "ts", as_of, 7)
    old = hotset.retention(demoted, as_of).select("id")
    kept = demoted.join(old, "id", "left_anti")
    decayed = sequences.decay(trans, as_of)
    kept_injections = memory.purge(injections, "injected_at", as_of, 7)
    penalties = hotset.penalize(kept)
    actions = feedback.feedback_actions(feedback.injection_value(kept_injections, kept, as_of))
    unused = hotset.decay_unused(kept, as_of)
    counts = {
        "demoted": stale, "expired_patterns": expired.filter("status = 'rejected'"), "kept_logs": kept_logs, "retired": old, "kept_transitions": decayed,
        "kept_injections": kept_injections, "penalties": penalties, "actions": actions, "unused": unused.filter("decayed"),
    }
    report = None
    for name, df in counts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        report = row if report is None else report.unionByName(row)
    return {"memories": unused.drop("stale", "decayed"), "patterns": expired, "logs": kept_logs, "transitions": decayed, "injections": kept_injections, "ledger": penalties, "actions": actions, "report": report}

"""Typed relationships between stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["from_id", "to_id", "relation_type"]


def link(edges: DataFrame, proposals: DataFrame, mem: DataFrame, relations: list[str]) -> DataFrame:
    """Proposed edges that are valid and new: known type, two different existing ends."""
    ids = mem.select("id").distinct()
    new = proposals.select(EDGE).filter(F.col("relation_type").isin(relations) & (F.col("from_id") != F.col("to_id"))).distinct()
    for end in ("from_id", "to_id"):
        new = new.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return new.join(edges.select(EDGE), EDGE, "left_anti").select(EDGE)


def unlink(edges: DataFrame, removals: DataFrame) -> DataFrame:
    """Edges without the removed ones; a removal without a type takes all types."""
    typed, loose = removals.filter("relation_type IS NOT NULL"), removals.filter("relation_type IS NULL")
    return edges.join(typed, EDGE, "left_anti").join(loose.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def related(edges: DataFrame, ids: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """id, other_id, relation_type, direction for every wanted id at once."""
    if relation is not None:
        edges = edges.filter(F.col("relation_type") == relation)
    parts = []
    if direction in ("both", "outgoing"):
        parts.append(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "relation_type", F.lit("outgoing").alias("direction")))
    if direction in ("both", "incoming"):
        parts.append(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), "relation_type", F.lit("incoming").alias("direction")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def edge_stats(edges: DataFrame) -> DataFrame:
    """Edges by type, and a row for all (relation_type null) with the number of linked rows."""
    nodes = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id"))
    by_type = edges.groupBy("relation_type").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("n_nodes"))
    total = edges.agg(F.count("*").alias("n")).crossJoin(nodes.agg(F.countDistinct("id").alias("n_nodes")))  # one row each
    return by_type.unionByName(total.select(F.lit(None).cast("string").alias("relation_type"), "n", "n_nodes"))


def contradiction_candidates(neighbours: DataFrame, edges: DataFrame, threshold: float = 0.75, most: int = 5) -> DataFrame:
    """Near pairs (query_id, id, similarity), at most so many per row, with whether they are linked already."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    near = neighbours.filter(F.col("similarity") >= threshold).withColumn("rank", rank).filter(F.col("rank") <= most)
    ends = edges.select(F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi")).distinct().withColumn("linked", F.lit(True))
    keyed = near.withColumns({"lo": F.least("query_id", "id"), "hi": F.greatest("query_id", "id")})
    return keyed.join(ends, ["lo", "hi"], "left").withColumn("already_linked", F.coalesce("linked", F.lit(False))).drop("lo", "hi", "linked")


def list_contradictions(edges: DataFrame, mem: DataFrame) -> DataFrame:
    rows = edges.filter("relation_type = 'contradicts'").select("from_id", "to_id")
    for end in ("from", "to"):
        rows = rows.join(mem.select(F.col("id").alias(f"{end}_id"), F.substring("content", 1, 100).alias(f"{end}_preview")), f"{end}_id")
    return rows


def auto_link(neighbours: DataFrame, threshold: float = 0.75, most: int = 3) -> DataFrame:
    """relates_to edges from each row to its nearest earlier rows."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    near = neighbours.filter((F.col("similarity") >= threshold) & (F.col("id") < F.col("query_id"))).withColumn("rank", rank).filter(F.col("rank") <= most)
    return near.select(F.col("query_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("relates_to").alias("relation_type"))


def resolve(edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, trust changes, ids to delete) after decisions (keep_id, drop_id, action: supersede, delete or weaken)."""
    pair = decisions.select(F.col("keep_id").alias("from_id"), F.col("drop_id").alias("to_id"), F.lit("contradicts").alias("relation_type"))
    back = pair.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation_type")
    left = unlink(edges, pair.unionByName(back))
    added = decisions.filter("action = 'supersede'").select(F.col("keep_id").alias("from_id"), F.col("drop_id").alias("to_id"), F.lit("supersedes").alias("relation_type"))
    trust = decisions.filter("action <> 'delete'").select(F.col("drop_id").alias("memory_id"), F.when(F.col("action") == "supersede", -0.20).otherwise(-0.30).alias("delta"))
    return left.unionByName(added).distinct(), trust, decisions.filter("action = 'delete'").select(F.col("drop_id").alias("id"))


def expand(results: DataFrame, edges: DataFrame, per_source: int = 3, factor: float = 0.8) -> DataFrame:
    """Neighbours of each query's results that it lacks: query_id, id, via_id, score. First source wins, few per source."""
    both = related(edges.filter("relation_type <> 'supersedes'"), results.select("id"), "both").unionByName(related(edges.filter("relation_type = 'supersedes'"), results.select("id"), "incoming"))
    found = results.select("query_id", "id", "rank", "score").join(both.select("id", "other_id").distinct(), "id")
    found = found.join(results.select("query_id", F.col("id").alias("other_id")), ["query_id", "other_id"], "left_anti")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "other_id").orderBy("rank"))).filter("n = 1")
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("other_id"))).filter(F.col("n") <= per_source)
    return few.select("query_id", F.col("other_id").alias("id"), F.col("id").alias("via_id"), (F.col("score") * factor).alias("score"))


def graph_nodes(edges: DataFrame, mem: DataFrame, limit: int = 100) -> DataFrame:
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    return mem.join(ids, "id", "left_semi").select("id", F.substring("content", 1, 40).alias("label")).orderBy("id").limit(limit)

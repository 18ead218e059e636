"""Vector and keyword retrieval for tables of queries, ranking, and grouping of similar rows."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import rules, scores
from lorebase.functions import text as tx
from lorebase.operators import cells, graph
from lorebase.sources.shared import cut

#: Centroids that are broadcast at most (4 MB at a thousand numbers each).
MOST_LABELS = 512


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


@lru_cache(maxsize=1 << 16)
def _signs(word: str, dim: int) -> np.ndarray:
    """Bits of the word's MD5 digests with a block's number, 128 a block, each 32 from the lowest bit on, as 1 and -1."""
    digests = b"".join(hashlib.md5(f"{word}:{i}".encode()).digest() for i in range((dim + 127) // 128))
    return np.unpackbits(np.frombuffer(digests, ">u4").astype("<u4").view(np.uint8), bitorder="little")[:dim] * 2.0 - 1


def hash_embed(df: DataFrame, key: str, text: str = "content", dim: int = 64) -> DataFrame:
    """key, embedding: normalised sum of pseudo-random sign vectors of the words; equal words give equal parts, no words zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 2)
    rows = df.select(key, words.alias("words"))

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            for i, own in enumerate(batch.column(1).to_pylist()):
                for word, n in Counter(own).items():
                    out[i] += n * _signs(word, dim)
            size = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.where(size > 0, out / np.where(size > 0, size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(out.ravel()))], [key, "embedding"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<double>")


def rank(cands: DataFrame, as_of: Column, boosts: DataFrame | None = None, lower: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(ranked, summary) of candidates by recall mode.

    cands: query_id, mode, id, similarity, keyword and the memory's columns. Access counts are relative to
    the most accessed candidate of the query, before the threshold; the summary counts what it removed.
    lower: taken off every mode's threshold, for vectors that are far apart.
    """
    mode = F.coalesce("mode", F.lit("balanced"))
    pick = lambda i: tx.choose(F.col("mode"), {m: v[i] for m, v in rules.MODES.items()}, rules.MODES["balanced"][i])
    by = Window.partitionBy("query_id")
    most = F.greatest(F.max("access_count").over(by), F.lit(1))
    rows = cands.withColumn("mode", mode).withColumn("fused", scores.fused(F.col("similarity"), F.col("keyword"))).withColumns({"threshold": pick(0) - lower, "limit": pick(1), "access_score": F.col("access_count") / most})
    parts = {
        "similarity_part": F.col("fused") * pick(2),
        "recency_part": scores.recency(F.coalesce("last_accessed_at", "created_at"), as_of) * pick(3),
        "access_part": F.col("access_score") * pick(4),
        "trust_part": 0.1 * scores.trust_decayed(F.coalesce("trust_score", F.lit(1.0)), F.col("created_at"), F.col("last_accessed_at"), F.col("memory_type"), F.col("access_count"), as_of),
        "helpfulness_part": 0.05 * F.coalesce("utility_score", F.lit(0.25)),
    }
    rows = rows.withColumns(parts)
    boost = F.lit(0.0)
    if boosts is not None:
        rows = rows.join(boosts, ["query_id", "category"], "left")
        boost = F.coalesce("boost", F.lit(0.0)) * 0.15 / 0.5
    rows = rows.withColumn("score", sum((F.col(c) for c in parts), boost)).withColumn("gated", F.col("fused") < F.col("threshold"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    ranked = rows.filter(~F.col("gated")).withColumn("rank", order).filter(F.col("rank") <= F.col("limit"))
    top = ranked.filter("rank = 1").select("query_id", F.col("similarity").alias("top_similarity"))
    counts = rows.groupBy("query_id").agg(F.sum(F.col("gated").cast("long")).alias("n_gated"), F.count("*").alias("n_candidates"))
    counts = counts.withColumn("n_results", F.col("n_candidates") - F.col("n_gated"))
    label = F.when(F.col("top_similarity").isNull(), "low").when(F.col("top_similarity") > 0.85, "high").otherwise("medium")
    return ranked, counts.join(top, "query_id", "left").withColumn("confidence", label)


def candidates(queries: DataFrame, vectors: DataFrame, k: int, keywords: DataFrame | None = None, union: bool = False) -> DataFrame:
    """(query_id, id, similarity, keyword) of the k nearest rows of each query.

    keywords (query_id, id, score): 0 where they have no score. union: rows with a keyword score are candidates too; those
    that are not among the nearest get their own similarity, or 0 without a vector.
    """
    near = cells.knn(queries, vectors, k).drop("rank")
    if keywords is None:
        return near.withColumn("keyword", F.lit(0.0))
    keywords = keywords.select("query_id", "id", F.col("score").alias("keyword"))
    if not union:
        return near.join(keywords, ["query_id", "id"], "left").na.fill(0.0, ["keyword"])
    both = near.join(keywords.join(queries.select("query_id"), "query_id", "left_semi").filter("id <> query_id"), ["query_id", "id"], "full")
    own = queries.select("query_id", F.col("embedding").alias("asked")), vectors.select("id", "embedding")
    both = both.join(own[0], "query_id").join(own[1], "id", "left")
    similarity = F.coalesce("similarity", F.when(F.col("embedding").isNotNull(), cosine("asked", "embedding")), F.lit(0.0))
    return both.select("query_id", "id", similarity.alias("similarity"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))


def guidance(summary: DataFrame) -> DataFrame:
    """Adds the code of what to make of a query's results: use, verify, filtered (all below the threshold), none, or none_precise (try a wider mode)."""
    code = F.when(F.col("n_results") > 0, F.when(F.col("confidence") == "high", "use").when(F.col("confidence") == "medium", "verify").otherwise("careful"))
    return summary.withColumn("guidance", F.coalesce(code, F.when(F.col("n_gated") > 0, "filtered").when(F.col("mode") == "precision", "none_precise").otherwise("none")))


def recall(queries: DataFrame, mem: DataFrame, vectors: DataFrame, as_of: Column, k: int = 10, keywords: DataFrame | None = None, boosts: DataFrame | None = None, lower: float = 0.0, where: Column | str | None = None, edges: DataFrame | None = None, union: bool = False) -> tuple[DataFrame, DataFrame]:
    """Batch recall: candidates (the 3k nearest; with union also those of keywords), ranking, and a summary of every query with its guidance.

    keywords: query_id, id, score. where: only memories that fulfil it are candidates. edges (from_id, to_id, relation_type): memories
    that are related to the ranked ones, also of other kinds than where asks for, follow them with a lesser score and no rank; via_id says by which.
    """
    every = mem
    if where is not None:
        mem = mem.filter(where)
        vectors = vectors.join(mem.select("id"), "id", "left_semi")
    modes = queries.select("query_id", F.coalesce("mode", F.lit("balanced")).alias("mode") if "mode" in queries.columns else F.lit("balanced").alias("mode"))
    # Written, as ranking and summary each read them, and finding them is the costly part.
    cands = cut(candidates(queries, vectors, 3 * k, keywords, union), "candidates").join(modes, "query_id").join(mem, "id")
    ranked, summary = rank(cands, as_of, boosts, lower)
    summary = modes.join(summary, "query_id", "left").na.fill(0, ["n_gated", "n_candidates", "n_results"]).na.fill("low", ["confidence"])
    summary = guidance(summary)
    if edges is None:
        return ranked, summary
    ranked = cut(ranked, "ranked")  # read for itself and for its neighbours
    return ranked.unionByName(graph.expand(ranked, edges).join(every, "id"), allowMissingColumns=True), summary


def recall_fallback(stages: list[tuple[DataFrame, DataFrame]], min_results: int = 1) -> DataFrame:
    """Of several recalls (ranked, summary) in order: per query the first with enough rows and confidence, else the fullest."""
    parts = [r.join(s.select("query_id", "confidence"), "query_id").withColumn("stage", F.lit(i)) for i, (r, s) in enumerate(stages)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sizes = rows.groupBy("query_id", "stage").agg(F.count("*").alias("n"), F.first("confidence").alias("confidence"))
    fine = (F.col("n") >= min_results) & (F.col("confidence") != "low")
    best = sizes.groupBy("query_id").agg(F.coalesce(F.min(F.when(fine, F.col("stage"))), F.max_by("stage", F.struct("n", (-F.col("stage")).alias("s")))).alias("stage"))
    return rows.join(best, ["query_id", "stage"], "left_semi")


def intent_boosts(queries: DataFrame) -> DataFrame:
    """(query_id, category, boost) from keywords; the largest boost of all intents."""
    arrays = []
    for words, categories in rules.INTENTS.values():
        hit = F.lower("text").rlike(tx.bounded(r"\b(?:" + "|".join(words) + r")\b"))
        gains = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(max(0.2, round(0.5 - 0.1 * i, 1))).alias("boost")) for i, c in enumerate(categories)])
        arrays.append(F.when(hit, gains).otherwise(F.slice(gains, 1, 0)))
    return queries.select("query_id", F.explode(F.concat(*arrays)).alias("b")).groupBy("query_id", F.col("b.category").alias("category")).agg(F.max("b.boost").alias("boost"))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Normalised mean vector of each label."""
    means = vectors.select(label, F.posexplode("embedding").alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("c"))
    size = norm("c")
    return rows.select(F.col(label).alias("label"), F.transform("c", lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("centroid"))


def classify_nearest(vectors: DataFrame, cents: DataFrame, threshold: float = 0.35) -> DataFrame:
    """id, label (null below the threshold), score: the centroid of the largest product, ties to the larger label.

    Up to MOST_LABELS centroids are sent to all vectors; more are dealt over blocks of vectors, and each
    vector keeps the best of every part.
    """
    spark = cents.sparkSession
    score = F.round("score", 9)
    if cents.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        scored = vectors.select("id", "embedding").crossJoin(F.broadcast(cents)).select("id", "label", dot("embedding", "centroid").alias("score"))
    else:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
        left = vectors.select("id", "embedding").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")
        scored = left.join(cents.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")), "part").select("id", "label", dot("embedding", "centroid").alias("score"))
    best = scored.groupBy("id").agg(F.max_by("label", F.struct(score, "label")).alias("label"), F.max("score").alias("score"))
    return best.withColumn("label", F.when(F.col("score") >= threshold, F.col("label")))


def classify_hybrid(texts: DataFrame, classified: DataFrame) -> DataFrame:
    return texts.join(classified, "id", "left").select("id", F.coalesce("label", tx.category_at_hits(F.when(F.col("label").isNull(), F.col("content")))).alias("category"))


def validate_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).withColumn("matches", F.col("width") == dim)


def rebuild_vectors(mem: DataFrame, embedder, dim: int, batch: int = 100) -> DataFrame:
    """id, embedding, error. embedder() is called once per worker and gives a function from texts to vectors."""

    def run(pdfs):
        embed = embedder()
        for pdf in pdfs:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    yield pd.DataFrame({"id": part.id, "embedding": [list(map(float, v)) for v in embed(part.content.tolist())], "error": None})
                except Exception as e:  # a failed batch becomes rows with its error
                    yield pd.DataFrame({"id": part.id, "embedding": None, "error": str(e)})

    return mem.select("id", "content").mapInPandas(run, "id long, embedding array<double>, error string")


def star_clusters(mem: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of greedy star clusters: (id, seed_id). mem: id, access_count, is_pinned; pairs: a, b.

    Seeds go by most accesses, then id; pinned rows are no seeds. A row becomes a seed once no better
    unassigned neighbour is left; each round decides all such rows at once and is written.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    order = F.struct((-F.col("access_count")).alias("n"), "id")
    nodes = cut(mem.join(ids, "id", "left_semi").select("id", order.alias("order"), "is_pinned"), "nodes")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    other = nodes.select(F.col("id").alias("other"), F.col("order").alias("other_order"), F.col("is_pinned").alias("other_pinned"))
    adjacent = cut(both.join(nodes, "id").join(other, "other"), "adjacent")
    open_ids, seeds = nodes.filter("NOT is_pinned").select("id"), None
    while True:
        live = adjacent.filter("NOT is_pinned AND NOT other_pinned").join(open_ids, "id", "left_semi").join(open_ids.select(F.col("id").alias("other")), "other", "left_semi")
        beaten = live.filter("other_order < order").select("id").distinct()
        now = cut(open_ids.join(beaten, "id", "left_anti"), "seeds")
        if not now.limit(1).count():
            break
        seeds = now if seeds is None else seeds.unionByName(now)
        covered = adjacent.join(now.select(F.col("id").alias("other")), "other", "left_semi").select("id")
        open_ids = cut(open_ids.join(now.union(covered), "id", "left_anti"), "open")
    if seeds is None:
        return nodes.select("id", F.col("id").alias("seed_id")).limit(0)
    near = adjacent.join(seeds.select(F.col("id").alias("other")), "other", "left_semi").join(seeds, "id", "left_anti")
    members = near.groupBy("id").agg(F.min_by("other", "other_order").alias("seed_id"))
    own = members.select(F.col("seed_id").alias("id")).distinct().select("id", F.col("id").alias("seed_id"))
    return members.unionByName(own)


def consolidation(members: DataFrame, mem: DataFrame, pairs: DataFrame, min_size: int = 2) -> DataFrame:
    """Per cluster: representative (hot first, then most accesses), members, accesses, united tags if mem has tags, mean similarity to the seed."""
    tagged = "tags" in mem.columns
    rows = members.join(mem.select("id", "is_hot", "access_count", *["tags"] * tagged), "id")
    near = pairs.select(F.col("a").alias("id"), F.col("b").alias("seed_id"), "similarity").union(pairs.select("b", "a", "similarity"))
    rows = rows.join(near, ["id", "seed_id"], "left")
    tags = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("combined_tags")] * tagged
    out = rows.groupBy("seed_id").agg(F.max_by("id", F.struct("is_hot", "access_count", (-F.col("id")).alias("i"))).alias("representative_id"), F.array_sort(F.collect_set("id")).alias("member_ids"), F.sum("access_count").alias("total_access"), F.avg("similarity").alias("avg_similarity"), *tags)
    return out.filter(F.size("member_ids") >= min_size)


def consolidation_savings(clusters: DataFrame) -> DataFrame:
    """One row: clusters, memories in them, memories that merging deletes, and that share in percent."""
    sizes = clusters.agg(F.count("*").alias("cluster_count"), F.coalesce(F.sum(F.size("member_ids")), F.lit(0)).alias("total_memories"))
    return sizes.withColumn("to_delete", F.col("total_memories") - F.col("cluster_count")).withColumn("savings_pct", F.when(F.col("total_memories") > 0, F.round(F.col("to_delete") / F.col("total_memories") * 100, 1)).otherwise(0.0))


def _gone(mem: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, representative_id) of the rows that merging deletes; pinned rows stay."""
    gone = clusters.select(F.explode("member_ids").alias("id"), "representative_id").filter("id <> representative_id")
    return gone.join(mem.filter("is_pinned").select("id"), "id", "left_anti")


def consolidate(mem: DataFrame, clusters: DataFrame) -> DataFrame:
    """The store after merging: members go, the representative has the summed accesses and all tags; pinned rows stay."""
    tagged = "tags" in mem.columns and "combined_tags" in clusters.columns
    total = clusters.select(F.col("representative_id").alias("id"), "total_access", *["combined_tags"] * tagged)
    out = mem.join(_gone(mem, clusters).select("id"), "id", "left_anti").join(total, "id", "left").withColumn("access_count", F.coalesce("total_access", "access_count")).drop("total_access")
    if tagged:
        out = out.withColumn("tags", F.array_sort(F.array_union(F.coalesce("tags", F.array()), F.coalesce("combined_tags", F.array())))).drop("combined_tags")
    return out


def rewire_edges(edges: DataFrame, mem: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges after merging: those of deleted rows go to or from their representative; none leads to itself or is there twice."""
    gone = _gone(mem, clusters)
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.select(F.col("id").alias(end), "representative_id"), end, "left").withColumn(end, F.coalesce("representative_id", end)).drop("representative_id")
    return edges.filter("from_id <> to_id").select("from_id", "to_id", "relation_type").distinct()


def group_results(results: DataFrame, vectors: DataFrame, threshold: float = 0.70, min_size: int = 2, most: int = 5) -> DataFrame:
    """Groups each query's result rows (at most about a hundred): query_id, id, group (null: left over).

    In rank order a row joins the first-formed group whose leader is nearest and near enough, opens a new group
    while there are fewer than most, or is left over.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        vec = np.array(pdf.embedding.tolist(), np.float64)
        leaders: list[int] = []
        group = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            sims = [float(vec[i] @ vec[j] / (np.linalg.norm(vec[i]) * np.linalg.norm(vec[j]) or 1.0)) for j in leaders]
            if sims and max(sims) >= threshold:
                group[i] = int(np.argmax(sims))
            elif len(leaders) < most:
                leaders.append(i)
                group[i] = len(leaders) - 1
        sizes = np.bincount(group[group >= 0], minlength=len(leaders) or 1)
        return pd.DataFrame({"query_id": pdf.query_id, "id": pdf.id, "group": pd.array([int(g) if g >= 0 and sizes[g] >= min_size else None for g in group], "Int32")})

    return results.join(vectors.select("id", "embedding"), "id").select("query_id", "id", "rank", "embedding").groupBy("query_id").applyInPandas(run, "query_id long, id long, group int")


def merge_targets(vectors: DataFrame, incoming: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(new_id, target_id, similarity) of the incoming rows that merge; the others are inserted.

    vectors, incoming: id, embedding. Rows come in the order of their ids, as if stored one by one: a row merges into the nearest
    of the stored rows and of the rows inserted before it, if that is near enough (ties: the smaller id). All similarities are
    those of the rows' own vectors. Each round decides all rows that no earlier undecided row can take, and is written.
    """
    stored = vectors.join(incoming.select("id"), "id", "left_anti")
    asked = incoming.select(F.col("id").alias("query_id"), "embedding")
    old = cells.knn(asked, stored, 1).filter(F.round("similarity", 12) >= threshold).select(F.col("query_id").alias("new_id"), F.col("id").alias("target_id"), "similarity")
    old = cut(old, "old")
    free = incoming.select(F.col("id").alias("new_id")).join(old, "new_id", "left_anti")
    pairs = cut(cells.similar_pairs(incoming, threshold - 1e-12).filter(F.round("similarity", 12) >= threshold), "pairs")
    undecided, leaders = cut(free, "undecided"), None
    while undecided.limit(1).count():
        open_pairs = pairs.join(undecided.select(F.col("new_id").alias("a")), "a", "left_semi").join(undecided.select(F.col("new_id").alias("b")), "b", "left_semi")
        now = cut(undecided.join(open_pairs.select(F.col("b").alias("new_id")), "new_id", "left_anti"), "leaders")
        leaders = now if leaders is None else leaders.unionByName(now)
        taken = pairs.join(now.select(F.col("new_id").alias("a")), "a", "left_semi").select(F.col("b").alias("new_id"))
        undecided = cut(undecided.join(now.union(taken), "new_id", "left_anti"), "undecided")
    if leaders is None:
        return old
    near = pairs.join(leaders.select(F.col("new_id").alias("a")), "a", "left_semi").join(leaders.select(F.col("new_id").alias("b")), "b", "left_anti")
    every = old.unionByName(near.select(F.col("b").alias("new_id"), F.col("a").alias("target_id"), "similarity"))
    best = F.struct(F.round("similarity", 12), -F.col("target_id"))
    return every.groupBy("new_id").agg(F.max_by("target_id", best).alias("target_id"), F.max_by("similarity", best).alias("similarity"))


def semantic_merge(existing: DataFrame, incoming: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    """The store after incoming rows merged into their targets or were inserted: existing's columns, and merged (how many came in).

    Rows: id, content, embedding, tags, access_count, last_accessed_at and more. A longer content replaces a shorter one with its vector and
    its hash, if there is one; tags are united, each merge is an access.
    """
    inserted = incoming.join(targets.select(F.col("new_id").alias("id")), "id", "left_anti")
    store = existing.unionByName(inserted, allowMissingColumns=True)
    new = incoming.select(F.col("id").alias("new_id"), "content", "embedding", "tags").join(targets, "new_id")
    longest = F.struct(F.char_length("content"), (-F.col("new_id")).alias("i"))
    came = new.groupBy(F.col("target_id").alias("id")).agg(F.max_by(F.struct("content", "embedding"), longest).alias("new"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array())))).alias("new_tags"), F.count("*").alias("merged"))
    out = store.join(came, "id", "left").withColumn("longer", F.coalesce(F.char_length("new.content") > F.char_length("content"), F.lit(False)))
    out = out.withColumns({
        "content": F.when(F.col("longer"), F.col("new.content")).otherwise(F.col("content")), "embedding": F.when(F.col("longer"), F.col("new.embedding")).otherwise(F.col("embedding")),
        "tags": F.array_sort(F.array_union(F.coalesce("tags", F.array()), F.coalesce("new_tags", F.array()))), "access_count": F.col("access_count") + F.coalesce("merged", F.lit(0)),
        "last_accessed_at": F.when(F.col("merged").isNotNull(), as_of).otherwise(F.col("last_accessed_at")), "merged": F.coalesce("merged", F.lit(0)),
    })
    if "content_hash" in existing.columns:
        out = out.withColumn("content_hash", F.when(F.col("longer"), F.sha2("content", 256)).otherwise(F.col("content_hash")))
    return out.select(*existing.columns, "merged")


def promotion_targets(patterns: DataFrame, mem: DataFrame, embed, min_count: int = 3, threshold: float = 0.95) -> DataFrame:
    """(pattern_hash, id, similarity) of the memory that each frequent pattern promotes: the smallest id of its very text, else the nearest near enough.

    embed: a function from (rows, key column, text column) to (key, embedding).
    """
    # What is read more than once is written: the frequent patterns, and the vectors, which the search counts, samples and places.
    often = cut(patterns.filter(F.col("count") >= min_count).select("pattern_hash", "pattern"), "often")
    exact = often.join(mem.select(F.col("id"), F.sha2("content", 256).alias("pattern_hash")), "pattern_hash").groupBy("pattern_hash").agg(F.min("id").alias("id")).withColumn("similarity", F.lit(1.0))
    rest = cut(often.join(exact.select("pattern_hash"), "pattern_hash", "left_anti").withColumn("query_id", F.monotonically_increasing_id()), "patterns")
    # The query's ids are apart from those of memories, since a row is not its own neighbour.
    asked = cut(embed(rest, "query_id", "pattern").withColumn("query_id", -F.col("query_id") - 1), "asked")
    near = cells.knn(asked, cut(embed(mem, "id", "content"), "embedded"), 1).filter(F.round("similarity", 12) >= threshold)
    found = near.join(rest.select((-F.col("query_id") - 1).alias("query_id"), "pattern_hash"), "query_id").select("pattern_hash", "id", "similarity")
    return exact.unionByName(found)

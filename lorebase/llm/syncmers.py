"""Document fingerprints from closed syncmers, with DataFrame functions only.

Letters are words (runs without white space); in texts with more than LONG code points a word, as in scripts that are
written without spaces, they are the code points. Of all runs of K letters, those are chosen whose
least inner run of S letters, by hash, is the first or the last one. The choice depends on these K letters alone, so
equal passages have equal anchors wherever they stand. A fingerprint is the sorted list of all different anchor hashes,
as hexadecimal numbers; places are all chosen runs with the number of their first letter, for positional matching;
likeness is the share of common anchors among all different anchors of both.

Defined results: a null or empty text has the empty fingerprint; texts of fewer than K letters, or without a
chosen run, have the hash of their whole sequence of letters, at place 0. Two empty fingerprints have likeness 1, an empty
and another one 0. Very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 6, 2
LONG = 16  # code points a word on average, spaces included; beyond that the code points are the letters
SKETCH = None  # how many least anchors of a text count: no limit


def _with_words(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds hashes of letters and of inner runs as columns, so that later lambdas only look them up."""
    df = df.withColumn(f"{to}_w", F.split(text, r"\s+"))
    df = df.withColumn(f"{to}_w", F.when(F.char_length(text) > LONG * F.size(f"{to}_w"), F.split(text, "")).otherwise(F.col(f"{to}_w")))
    df = df.withColumn(f"{to}_w", F.transform(f"{to}_w", lambda w: F.xxhash64(w)))
    inner = f"CASE WHEN size({to}_w) >= {K} THEN transform(sequence(0, size({to}_w) - {S}), i -> xxhash64({', '.join(f'{to}_w[i + {j}]' for j in range(S))})) END"
    return df.withColumn(f"{to}_s", F.expr(inner))


def _anchor(to: str, i: str = "i") -> tuple[str, str]:
    """SQL of (whether run i is chosen, its hash)."""
    last = K - S
    edge = f"least({to}_s[{i}], {to}_s[{i} + {last}])"
    inside = f"least({', '.join(f'{to}_s[{i} + {j}]' for j in range(1, last))})"
    return f"{edge} <= {inside}", f"xxhash64({', '.join(f'{to}_s[{i} + {j}]' for j in range(0, last + 1, S))})"


def with_sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds to: the sorted different anchor hashes of column text; <to>_places: (position, anchor) of every chosen run."""
    out = _with_words(df, text, to)
    chosen, value = _anchor(to)
    out = out.withColumn(f"{to}_a", F.expr(f"CASE WHEN {to}_s IS NOT NULL THEN array_compact(transform(sequence(0, size({to}_w) - {K}), i -> CASE WHEN {chosen} THEN named_struct('position', i, 'anchor', {value}) END)) END"))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(f"{to}_w").alias("anchor")))
    out = out.withColumn(f"{to}_places", F.when(F.col(text) == "", F.slice(whole, 1, 0)).when(F.size(f"{to}_a") > 0, F.col(f"{to}_a")).otherwise(whole)).drop(f"{to}_w", f"{to}_s", f"{to}_a")
    return out.withColumn(to, F.sort_array(F.array_distinct(F.col(f"{to}_places")["anchor"])))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chosen run: doc_id, position (number of its first letter, from 0), anchor; for positional matching."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen, value = _anchor("x", "position")
    df = _with_words(df, "text", "x").filter("x_s IS NOT NULL").withColumn("position", F.explode(F.expr(f"sequence(0, size(x_w) - {K})")))
    return df.filter(F.expr(chosen)).select("doc_id", "position", F.expr(value).alias("anchor"))


def likeness(a: str, b: str) -> Column:
    """a, b: arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(common / (F.size(a) + F.size(b) - common), F.lit(0.0)))


def written(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ",")


def with_next(rows: DataFrame) -> DataFrame:
    """Adds own and own_places (see with_sketch), next_text and next_own of the following row by doc_id; the first row follows the last.

    Ids are cut into ranges by approximate quantiles, and each range also gets the first row of the range
    after it, so no range needs another one and the texts are moved once; their anchors are found where they then lie.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    number = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]).cast("array<long>"), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(number))
    order = F.struct("doc_id", F.xxhash64("text"))
    firsts = ranged.groupBy("range").agg(F.min_by("text", order).alias("text"))
    numbers = [r.range for r in ranged.select("range").distinct().orderBy("range").collect()]  # a number per range
    if not numbers:
        own = with_sketch(rows, "text", "own")
        return own.select("*", F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    before = {r: numbers[i - 1] for i, r in enumerate(numbers)}
    to = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    ends = firsts.select(F.element_at(to, F.col("range")).alias("range"), "text", F.lit(True).alias("end"))
    both = ranged.withColumn("end", F.lit(False)).unionByName(ends, allowMissingColumns=True).repartition("range")
    by = Window.partitionBy("range").orderBy("end", "doc_id", F.xxhash64("text"))
    return with_sketch(both, "text", "own").select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in ("text", "own")]).filter(~F.col("end")).drop("range", "end")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, places, edited_places, near_edited, near_next per row.

    The edited text has the last quarter of its characters replaced by as many from the next document's start.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))).withColumn("n_chars", n.cast("long"))
    rows = with_sketch(rows.select("doc_id", "n_chars", "own", "own_places", "next_own", "edited"), "edited", "other")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written("own").alias("fingerprint"), written("other").alias("edited_fingerprint"),
        F.col("own_places").alias("places"), F.col("other_places").alias("edited_places"), likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )

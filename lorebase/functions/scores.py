"""Time-decayed scores as column expressions; as_of is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions import rules
from lorebase.functions.text import choose, days_between, ttl_days


def recency(ts: Column, as_of: Column, half_life: float = 30.0) -> Column:
    """2 to the power of minus age by half-life; 0 without a time."""
    return F.coalesce(F.pow(F.lit(2.0), -days_between(ts, as_of) / half_life), F.lit(0.0))


def trust_decayed(base: Column, created: Column, accessed: Column, kind: Column, uses: Column, as_of: Column) -> Column:
    """Base trust that halves with age by kind, slowed by use, never above the base."""
    age = days_between(F.coalesce(accessed, created), as_of)
    decay = F.pow(F.lit(2.0), -age / choose(kind, rules.TRUST_HALF_LIFE, 90.0))
    slowed = F.least(F.lit(1.5), 1 + 0.1 * F.log1p(uses.cast("double")))
    return F.least(base, F.when(age <= 0, base).otherwise(base * decay * slowed))


def hot_score(uses: Column, accessed: Column, as_of: Column) -> Column:
    return uses * 1.0 + 0.5 * recency(accessed, as_of, 7.0)


def salience_parts(importance: Column, trust: Column, uses: Column, accessed: Column, as_of: Column, most: int = 10) -> dict[str, Column]:
    return {
        "importance_part": importance * 0.15,
        "trust_part": trust * 0.15,
        "access_part": F.least(F.lit(1.0), uses / F.lit(float(most))) * 0.40,
        "recency_part": recency(accessed, as_of, 14.0) * 0.30,
    }


def salience(importance: Column, trust: Column, uses: Column, accessed: Column, as_of: Column, most: int = 10) -> Column:
    i, t, a, r = salience_parts(importance, trust, uses, accessed, as_of, most).values()
    return F.bround(i + t + a + r, 3)


def helpfulness(used: Column, retrieved: Column, alpha: float = 1.0, beta: float = 3.0) -> Column:
    return (used + alpha) / (retrieved + alpha + beta)


def helpfulness_decayed(utility: Column, last_used: Column, category: Column, as_of: Column) -> Column:
    return F.when(last_used.isNull(), utility * 0.8).otherwise(utility * F.pow(F.lit(0.95), days_between(last_used, as_of) / ttl_days(category)))


def fused(similarity: Column, keyword: Column, weight: float = 0.3, pivot: float = 0.4) -> Column:
    """Keyword evidence weighs more where the similarity is below the pivot."""
    low = weight * (1 - similarity / pivot)
    share = F.when(similarity < pivot, low).otherwise(0.3 * weight)
    return F.when(F.coalesce(keyword, F.lit(0.0)) <= 0, similarity).otherwise(similarity * (1 - share) + keyword * share)

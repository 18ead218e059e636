"""Column expressions over texts. All but category_at_hits stay in the JVM."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions import literals, rules


def choose(key: Column, table: dict, default) -> Column:
    """table[key], default for null and unknown keys."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def needed(parsed) -> set[str]:
    """Lower-cased ASCII texts one of which every match of a parsed expression holds; empty: none is known."""
    best, run = set(), ""

    def better(found: set[str]) -> None:
        nonlocal best
        if found and all(found) and (not best or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        better({run} if run else set())
        run = ""
        if name == "SUBPATTERN":
            better(needed(value[3]))
        elif name == "BRANCH":
            parts = [needed(option) for option in value[1]]
            better(set().union(*parts) if all(parts) else set())
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            better(needed(value[2]))
    better({run} if run else set())
    return best


def bounded(pattern: str) -> str:
    """The expression with word boundaries of ASCII letters, as its other classes are; Java's own also heed letters of other scripts."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def matches(text: Column, patterns: list[str], flags: str = "", ascii_edges: bool = False) -> Column:
    """How many of the patterns occur; ascii_edges: word boundaries know ASCII letters only. A pattern is only tried where a text that it needs occurs, which is far cheaper to see."""
    out, low = F.lit(0), F.lower(text)
    for pattern in patterns:
        texts = sorted(needed(re._parser.parse(pattern)))
        found = text.rlike(flags + (bounded(pattern) if ascii_edges else pattern))
        if texts and len(texts) <= 12:
            found = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in texts]) & found
        out = out + found.cast("int")
    return out


def importance_parts(text: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(length score, code matches, code score, entity matches, entity score)."""
    n = F.char_length(text)
    length = F.when(n < 20, 0.2).when(n < 100, 0.5).when(n < 500, 1.0).when(n < 2000, 0.8).otherwise(0.6)
    code, entity = matches(text, rules.CODE_SIGNS), matches(text, rules.ENTITY_SIGNS)
    return length, code, F.least(F.lit(1.0), code * 0.25), entity, F.least(F.lit(1.0), entity * 0.2)


def importance(text: Column, length_weight: float = 0.3, code_weight: float = 0.4, entity_weight: float = 0.3) -> Column:
    length, _, code, _, entity = importance_parts(text)
    total = length * length_weight + code * code_weight + entity * entity_weight
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3)


@lru_cache(maxsize=1)
def _categories() -> tuple[literals.Presence, list[tuple[str, int, int]]]:
    """Expressions of all categories, and of each category, by priority, those that are its own: (name, first, end)."""
    patterns, spans = [], []
    for name in rules.CATEGORY_PRIORITY:
        spans.append((name, len(patterns), len(patterns) + len(rules.CATEGORY_PATTERNS[name])))
        patterns += rules.CATEGORY_PATTERNS[name]
    return literals.Presence(patterns, re.IGNORECASE | re.MULTILINE), spans


def category_of(text: str | None) -> str | None:
    presence, spans = _categories()
    found = presence.found(text) if text else []
    name, score = max(((name, sum(found[lo:hi])) for name, lo, hi in spans), key=lambda x: x[1])  # the first of equal ones
    return name if score else None


def category(text: Column) -> Column:
    """The category with most matching patterns, ties by priority; null without a match."""
    ranked = [F.struct(matches(text, rules.CATEGORY_PATTERNS[c], "(?im)", ascii_edges=True).alias("score"), F.lit(-i).alias("priority"), F.lit(c).alias("name")) for i, c in enumerate(rules.CATEGORY_PRIORITY)]
    return F.array_max(F.filter(F.array(*ranked), lambda x: x.score > 0))["name"]


def category_at_hits(text: Column) -> Column:
    """category for long texts, in Arrow batches: all expressions share one pass over a text and are tried at their literals alone."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([category_of(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def scope(cat: Column) -> Column:
    return choose(cat, rules.SCOPE, "stable")


def scope_factor(cat: Column) -> Column:
    return choose(scope(cat), rules.SCOPE_FACTOR, 1.0)


def ttl_days(cat: Column) -> Column:
    return choose(cat, rules.CATEGORY_TTL, 30.0)


def promotable(cat: Column) -> Column:
    return F.coalesce(~cat.isin(rules.NEVER_PROMOTED), F.lit(True))


def promotion_threshold(cat: Column, default: float = 0.5) -> Column:
    """0.6 of the default for high-value categories, within 0.1 and 0.95; uncategorised: the default."""
    return F.when(cat.isNull(), default).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.when(cat.isin(rules.HIGH_VALUE), 0.6).otherwise(1.0) * default)))


def auto_pin(cat: Column, trust: Column) -> Column:
    return F.coalesce(cat.isin(rules.HIGH_VALUE) & (trust >= 0.8), F.lit(False))


def redact(text: Column) -> Column:
    for pattern, mark in rules.REDACTIONS:
        text = F.regexp_replace(text, "(?i)" + pattern, mark)
    return text


def secret_rules(text: Column) -> Column:
    """Numbers of the detection rules that match, from 0."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(i)) for i, p in enumerate(rules.SECRET_SIGNS)]))


def may_contain_secrets(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(rules.SECRET_SIGNS))


def normalize_repo(url: Column) -> Column:
    """host/path of a repository address; null if it is none."""
    clean = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    out = F.lit(None).cast("string")
    for pattern in (r"^ssh://[^@]+@([^/]+)/(.+)", r"^https?://([^/]+)/(.+)", r"^git@([^:]+):(.+)"):
        host = F.lower(F.regexp_extract(clean, pattern, 1))
        host = F.when(host == "github.com", "github").when(host == "gitlab.com", "gitlab").when(host == "bitbucket.org", "bitbucket").otherwise(host)
        out = F.when(clean.rlike(pattern), F.concat_ws("/", host, F.regexp_extract(clean, pattern, 2))).otherwise(out)
    return out


STRIPPED = "`'\"()[]{}<>,.;:!?"


def distinctive_tokens(text: Column, cap: int = 10) -> Column:
    """First tokens of six or more characters with a mark, a digit or an inner capital."""
    edge = "[" + "".join("\\" + c for c in STRIPPED) + "]+"
    tokens = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, "^" + edge, ""), edge + "$", ""))
    kept = F.filter(tokens, lambda t: (F.char_length(t) >= 6) & t.rlike(r"[_./:\-0-9]|^.+[A-Z]"))
    return F.slice(F.array_distinct(kept), 1, cap)


def staleness(last_used: Column, kind: Column, as_of: Column) -> Column:
    days = F.floor(days_between(last_used, as_of)).cast("int")
    return F.when(last_used.isNull(), "never verified").when(days >= choose(kind, rules.STALE_DAYS, 14), F.concat(F.lit("stale "), days.cast("string"), F.lit("d")))


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def similarity_label(similarity: Column, high: float = 0.85, medium: float = 0.7) -> Column:
    return F.when(similarity >= high, "high").when(similarity >= medium, "medium").otherwise("low")


def trust_label(trust: Column) -> Column:
    return F.when(trust >= 0.8, "high").when(trust >= 0.5, "medium").otherwise("low")

"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lorebase.functions import rules
from lorebase.sources import tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = tables.AS_OF


def query(sql: str | None = None, views: str = ""):
    """Registers a function (spark, sf_dir) under its name; views: names of views that the SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            with_ = ", ".join(tables.sql(v) for v in views.split())
            ORACLE_SQL[f.__name__] = (f"WITH {with_}" + (", " if sql.lstrip().startswith("+") else " ") if with_ else "") + sql.lstrip().removeprefix("+").lstrip()
        return f

    return add


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(key: str, table: dict, default: str) -> str:
    """table[key] in SQL."""
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END"


def days(earlier: str, later: str = AS_OF) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


def recency(ts: str, half_life: float) -> str:
    return f"coalesce(pow(2.0, -{days(ts)} / {half_life}), 0.0)"


def salience() -> str:
    return f"(importance_score * 0.15 + trust_score * 0.15 + least(1.0, access_count / 10.0) * 0.40 + {recency('last_accessed_at', 14.0)} * 0.30)"


def trust_now() -> str:
    age = days("coalesce(last_accessed_at, created_at)")
    half = case("memory_type", rules.TRUST_HALF_LIFE, "90.0")
    return f"least(trust_score, CASE WHEN {age} <= 0 THEN trust_score ELSE trust_score * pow(2.0, -{age} / {half}) * least(1.5, 1 + 0.1 * ln(access_count + 1)) END)"


def hot_score() -> str:
    return f"(access_count * 1.0 + 0.5 * {recency('last_accessed_at', 7.0)})"


SCOPE = rules.SCOPE

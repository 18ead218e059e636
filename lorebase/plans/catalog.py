"""Registered queries over the driver's tables, with SQL that expresses each."""

from __future__ import annotations

from lorebase.plans import registry
from lorebase.plans import store, retrieval, extraction, streaming  # noqa: F401  (they register their queries)

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL

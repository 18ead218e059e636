"""Every registered query with SQL returns the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lorebase.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(pdf: pd.DataFrame) -> list:
    out = []
    for row in pdf[sorted(pdf.columns)].itertuples(index=False):
        cells = []
        for x in row:
            if x is None or x is pd.NA or x != x:
                cells.append("NULL")
            elif isinstance(x, float):
                cells.append(f"{x:.6g}")
            else:
                try:
                    cells.append(f"{float(x):.6g}" if not isinstance(x, (str, bool)) else str(x))
                except (TypeError, ValueError):
                    cells.append(str(x))
        out.append(tuple(cells))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def near_pairs(duck, least):
    return duck.sql(f"SELECT a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {least - 1e-9}").fetchall()


def check_extracted(out, duck):
    n = duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    by = {r.kind: r for r in out}
    for kind in ("import", "fact", "command", "decision", "explanation", "api_endpoint", "entity_decision"):
        assert by[kind].n >= by[kind].n_logs == n  # the marked sentence of each log at least


def check_mining(out, duck):
    counters = {r.counter: r.n for r in out}
    n = duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert counters["logs"] == n and counters["found"] >= 4 * n and all(x >= 0 for x in counters.values())


def check_cleanup(out, duck):
    steps = {r.step: r.n for r in out}
    assert len(steps) == len(out) == 9 and all(x is not None and x >= 0 for x in steps.values())
    assert steps["demoted"] <= duck.sql("SELECT count(*) FROM documents WHERE doc_id % 10 = 0").fetchall()[0][0]


def check_embeddings(out, duck):
    assert len({r.id for r in out}) == len(out) > 0 and all(r.length == pytest.approx(1) or r.length == 0 for r in out)


def check_fallback(out, duck):
    assert {r.stage for r in out} <= {0, 1, 2} and all(0 < r.n_queries <= r.n for r in out)
    assert sum(r.n_queries for r in out) <= duck.sql("SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0").fetchall()[0][0]


def check_stars(out, duck):
    near = set(near_pairs(duck, 0.36))
    assert len({r.id for r in out}) == len(out) > 0
    assert all((r.id, r.seed_id) in near for r in out if r.id != r.seed_id)  # members are near their seed


def check_consolidation(out, duck):
    known = {x for x, in duck.sql("SELECT doc_id FROM documents").fetchall()}
    assert len({r.seed_id for r in out}) == len(out) > 0 and all(r.n >= 2 and {r.seed_id, r.representative_id} <= known and r.total_access >= 0 for r in out)


def check_groups(out, duck):
    near, groups = set(near_pairs(duck, 0.3)), {}
    for r in out:
        if r.group >= 0:
            groups.setdefault((r.query_id, r.group), []).append(r.id)
    assert groups and all(len(set(g)) == len(g) >= 2 for g in groups.values())
    for g in groups.values():  # every member is near another one
        assert all(any((x, y) in near for y in g) for x in g)


CHECKS = {
    "ext15_extract_all": check_extracted, "min08_run_mining": check_mining, "hot10_full_cleanup": check_cleanup, "vec01_hash_embed": check_embeddings, 
    "vec09_fallback": check_fallback, "vec10_star_clusters": check_stars, "vec11_consolidation": check_consolidation, "vec12_group_results": check_groups,
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) | set(CHECKS)))
def test_claims(spark, duck, name):
    CHECKS[name](catalog.QUERIES[name](spark, FOLDER).collect(), duck)

"""Exact top k and hard negatives against brute force, and what their bounds leave to score."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import blocks, negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label int, part int, block int, side string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 7, 7, "x") for i, v, label in rows], SCHEMA)


def clustered(n, dim, rng, groups=6, noise=0.4):
    centres = rng.normal(size=(groups, dim))
    return [(i, (lambda v: v / np.linalg.norm(v))(centres[i % groups] + noise * rng.normal(size=dim)), int(rng.integers(0, 4))) for i in range(n)]


def awkward(rng, dim=8):
    rows = clustered(260, dim, rng)
    same = rows[3][1]
    rows += [(1000 + i, same, i % 4) for i in range(130)]  # copies, beyond a block
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 2), (2003, [math.nan] * dim, 1), (2004, [None] + [0.1] * (dim - 1), 1), (2005, [math.inf] + [0.0] * (dim - 1), 2), (2006, [1.0], 1), (None, same, 1), (2010, same, None)]
    rows += [(0, rows[0][1], rows[0][2])] * 3 + [(20, rows[5][1], 3), (20, rows[6][1], 3)]
    return rows


def settled(rows, scale, dim, with_labels):
    """Integer vectors that take part, one per id."""
    out = {}
    for i, v, label in rows:
        if i is None or v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v) or (with_labels and label is None):
            continue
        key = (label if with_labels else 0, [float(x) for x in v])
        out[i] = max(out.get(i, key), key)
    return {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in out.items()}


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(rows, dim, k=10, scale=1024):
    v = settled(rows, scale, dim, False)
    return sorted((q, r + 1, i, -s) for q in v if q % 10 == 0 for r, (s, i) in enumerate(sorted((-dot(v[q][1], v[i][1]), i) for i in v if i != q)[:k]))


def brute_negatives(rows, dim, scale=256):
    v, out = settled(rows, scale, dim, True), []
    for a in v:
        if a % 10 == 0:
            ranked = sorted((-dot(v[a][1], v[i][1]), i) for i in v if i != a)
            for s, p in [x for x in ranked if v[x[1]][0] == v[a][0]][:5]:
                fits = [(-n, i) for n, i in ranked if v[i][0] != v[a][0] and 50 * -s <= 100 * -n <= 95 * -s][:3]
                out += [(a, p, r + 1, i, -s, n) for r, (n, i) in enumerate(fits)]
    return sorted(out)


@pytest.fixture(params=[1 << 21, 500])
def small_parts(request, monkeypatch):
    """One part, and many."""
    monkeypatch.setattr(blocks, "PART_NUMBERS", request.param)
    monkeypatch.setattr(blocks, "BLOCK", 128 if request.param > 500 else 8)


def asked():
    return F.col("vec_id") % 10 == 0


def test_top_equals_brute_force(spark, small_parts):
    rows = awkward(np.random.default_rng(1))
    got = topk.search(table(spark, rows), asked())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 8)


def test_negatives_equal_brute_force(spark, small_parts):
    rows = awkward(np.random.default_rng(2))
    got = negatives.mine(table(spark, rows), asked(), F.col("label"))
    want = brute_negatives(rows, 8)
    assert want and sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == want


def test_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1e5).tolist(), i % 2) for i in range(40)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table(spark, rows), asked(), scale=1024.0).collect()) == brute_top(rows, 4)
    got = negatives.mine(table(spark, rows), asked(), F.col("label"))
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == brute_negatives(rows, 4)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, [1.0], None), (10, None, 1)]])
def test_few_rows(spark, rows):
    assert topk.search(table(spark, rows), asked()).collect() == []
    assert negatives.mine(table(spark, rows), asked(), F.col("label")).collect() == []


def test_intervals_hold_the_product():
    rng = np.random.default_rng(4)
    for dim in (1, 3, 64, 100):
        x, q = (np.floor(256 * rng.normal(size=(n, dim))) for n in (200, 30))
        centre = np.rint(x.mean(axis=0))
        lower, upper = negatives.intervals(q, *negatives.encode(x - centre), (q @ centre)[:, None])
        true = q @ x.T
        assert (lower <= true).all() and (true <= upper).all()
    rest = negatives.encode(x)[2]
    assert (rest < 0.75 * np.linalg.norm(x, axis=1)).all()  # the code tells most of a vector


def test_bounds_leave_little_of_alike_rows():
    """What is scored of vectors in narrow groups: under a fifth of all."""
    rng = np.random.default_rng(5)
    rows = clustered(8192, 32, rng, groups=64, noise=0.05)
    ids, matrix = np.array([r[0] for r in rows]), np.floor(1024 * np.array([r[1] for r in rows]))
    order = blocks.alike(matrix)
    assert sorted(order.tolist()) == list(range(len(rows)))
    part = topk.Part(ids[order], np.arange(len(rows)) // blocks.BLOCK, matrix[order])
    q = matrix[:50]
    score, found = part.top(ids[:50], q, 10, np.full(50, -np.inf), np.full(50, topk.MOST))
    want = np.where(ids[None, :] == ids[:50, None], -np.inf, q @ matrix.T)
    assert (score == -np.sort(-want, axis=1)[:, :10]).all()
    assert part.visited < 0.2 * 50 * len(rows)
    labels = np.array([r[0] % 64 for r in rows])
    order = np.concatenate([np.flatnonzero(labels == c) for c in range(64)])
    whole = matrix[order] // 4
    block = np.arange(len(rows)) // 128
    codes = [negatives.encode(m - negatives._centre(m)) for m in np.split(whole, 64)]
    coded = negatives.Part(ids[order], labels[order], block, whole, *(np.concatenate([c[i] for c in codes]) for i in range(3)))
    lower, upper = coded.between(whole[:20], slice(0, len(rows)))
    true = whole[:20] @ whole.T
    least = np.partition(lower, -10, axis=1)[:, -10:-9]
    assert (upper >= true).all() and (lower <= true).all() and (upper >= least).mean() < 0.2

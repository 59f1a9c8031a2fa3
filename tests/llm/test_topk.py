"""Exact top-k against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagewright.llm")
from pagewright.llm import topk as T  # noqa: E402


def brute(rows, k):
    usable = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        point = [math.floor(64 * float(np.float32(x))) for x in vector]
        usable[vec_id] = min(usable.get(vec_id, point), point)
    out = set()
    for q, asked in usable.items():
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(asked, p)), v) for v, p in usable.items() if v != q and len(p) == len(asked)]
            out |= {(q, rank + 1, v, -s) for rank, (s, v) in enumerate(sorted(scores)[:k])}
    return out


def run(spark, rows, **sizes):
    frame = spark.createDataFrame([(v, x, 1, 2) for v, x in rows], "vec_id long, embedding array<float>, score int, rank int")
    return {tuple(r) for r in T.top_k(frame, F.col("vec_id") % 20 == 0, **sizes).collect()}


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, dims))
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 70, "block_rows": 7}])
def test_equals_all_pairs(spark, sizes):
    rows = vectors(400, 8, 1) + [(1_000 + i, [0.5] * 8) for i in range(150)]  # ties
    assert run(spark, rows, **sizes) == brute(rows, 20)


def test_odd_rows(spark):
    rows = vectors(30, 4, 2) + [
        (40, None),
        (41, [1.0, None, 0.0, 0.0]),
        (42, [1.0, float("nan"), 0.0, 0.0]),
        (43, [float("inf"), 0.0, 0.0, 0.0]),
        (None, [1.0, 0.0, 0.0, 0.0]),
        (60, [1e9, -1e9, 1e9, 3.0]),
        (61, [1e9, 1e9, 0.5, 3.0]),
        (80, [1.0, 2.0]),
        (81, [3.0, -2.0]),
        (100, []),
        (101, []),
        (20, [9.0, 9.0, 9.0, 9.0]),
    ]
    rows = [r for r in rows if r[0] not in (60, 61)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == set()


def test_scores_beyond_doubles(spark):
    rows = [(20, [2.0**20, 1.0]), (40, [2.0**20, -1.0]), (1, [2.0**20, 3.0]), (2, [-(2.0**20), 5.0])]
    assert run(spark, rows) == brute(rows, 20)


def test_trees_are_cut(monkeypatch):
    """Clustered rows: most leaves are never scored."""
    rng = np.random.default_rng(3)
    points = np.repeat(rng.integers(-60, 60, (32, 16)), 256, axis=0) + rng.integers(-2, 3, (8192, 16))
    ids = np.arange(len(points))
    seen = []
    real = np.rint
    monkeypatch.setattr(T.np, "rint", lambda x: seen.append(x.size) or real(x))
    T.search_shard(points[:64], ids[:64], None, points, ids)
    assert sum(seen) < 0.3 * 64 * len(points)

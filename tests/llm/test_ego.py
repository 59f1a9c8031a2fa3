"""Grid order join against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import ego as E  # noqa: E402


def brute(rows):
    def usable(v, label, vector):
        return (
            v is not None
            and label is not None
            and vector is not None
            and all(x is not None and math.isfinite(x) for x in vector)
            and any(vector)
        )

    ok = [(v, label, np.array(x, dtype=np.float64)) for v, label, x in rows if usable(v, label, x)]
    links, root = {v: 0 for v, _, _ in rows}, {v: v for v, _, _ in rows}
    pairs = []
    for i, (v, label, x) in enumerate(ok):
        for w, other, y in ok[:i]:
            if label == other and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / (np.linalg.norm(x1) * np.linalg.norm(y1)) >= 0.98:
                    pairs.append((v, w))
                    links[v] += 1
                    links[w] += 1
    changed = True
    while changed:
        changed = False
        for v, w in pairs:
            low = min(root[v], root[w])
            if root[v] != low or root[w] != low:
                root[v] = root[w] = low
                changed = True
    return sorted((v, links[v], root[v], v == root[v]) for v, _, _ in rows if v is not None)


def run(spark, rows):
    frame = spark.createDataFrame([(v, x, label, 5, 6) for v, label, x in rows], "vec_id long, embedding array<float>, label int, node int, size int")
    return [tuple(r) for r in E.vector_groups(frame).collect()]


def rows_of(n, dims, seed):
    rng = np.random.default_rng(seed)
    out, last = [], None
    for i in range(n):
        near = last is not None and rng.random() < 0.5
        x = last + rng.normal(size=dims) * np.abs(last).mean() * 0.12 if near else rng.normal(size=dims)
        last = x
        out.append((i, int(rng.integers(0, 3)), [float(np.float32(v)) for v in x]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, small, monkeypatch):
    if small:  # several intervals and levels
        monkeypatch.setattr(E, "BLOCK_ROWS", 16)
        monkeypatch.setattr(E, "FAN", 3)
        monkeypatch.setattr(E, "LEAF_ROWS", 4)
    rows = rows_of(260, 6, 4)
    rows += [(1_000 + i, 1, rows[7][2]) for i in range(40)]  # copies
    assert sorted(run(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(5, 1, a), (4, 1, a), (6, 2, a), (7, None, a), (8, 1, None), (9, 1, [1.0, None, 3.0]), (10, 1, [0.0] * 3)]
    rows += [(11, 1, [float("nan"), 1.0, 1.0]), (12, 1, [float("inf"), 1.0, 1.0]), (13, 1, []), (14, 1, [1.0, 2.0])]
    rows += [(15, 1, [2e30, 4e30, 6e30]), (16, 1, [1e-30, 2e-30, 3e-30]), (17, None, None)]
    assert sorted(run(spark, rows)) == brute(rows)
    with_null = run(spark, [*rows, (None, 1, a)])
    assert (None, 0, None, True) in with_null and len(with_null) == len(rows) + 1
    twice = run(spark, [(1, 1, a), (1, 1, a), (2, 1, a)])
    assert sorted(twice) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert run(spark, []) == []

"""Near-copy links of the SimHash operator against all pairs of shingle sets."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import shingles, simhash  # noqa: E402

from .test_simhash import brute_fingerprint  # noqa: E402

DIR = "/root/testdata/sf0.01"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_all_pairs(rows):
    rows = sorted(rows)
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    fps, sets = [brute_fingerprint(t) for _, t in rows], [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or shared and 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((top(rows[i][0]), top(rows[j][0])))
                root[b] = a
    return sorted(d for d in root if root[d] == d)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.first_of_each_group(docs, jaccard=True).collect())


@pytest.mark.parametrize("hot", [500, 3])
def test_near_copies_of_any_bits(spark, monkeypatch, hot):
    monkeypatch.setattr(shingles, "HOT_ROWS", hot)
    rng, rows = random.Random(3), []
    bases = [[f"w{rng.randrange(4000)}" for _ in range(rng.randint(4, 150))] for _ in range(8)]
    passage = [f"common{i}" for i in range(30)]
    for d in range(120):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
        rows.append((d, " ".join(words + passage * (d % 3 == 0))))
    want = kept_by_all_pairs(rows)
    assert kept(spark, rows) == want and len(want) < 100


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert kept(spark, rows) == kept_by_all_pairs(rows)

"""SimHash groups against all pairs of fingerprints."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("pagewright.llm")
from pagewright.llm import simhash as S  # noqa: E402
from pagewright.llm.queries import QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.01"


def brute_fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps):
    parent = dict(enumerate(ids))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(parent[i], parent[j])
            if parent[i] != low or parent[j] != low:
                parent[i] = parent[j] = low
                changed = True
    return [parent[i] for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    groups = brute_groups([r.doc_id for r in docs], fps)
    want = {(r.doc_id, f"{fp:016x}", g) for r, fp, g in zip(docs, fps, groups)}
    got = QUERIES["op2_simhash_near_dedup"](spark, DIR).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(docs)


@pytest.mark.parametrize("node_rows", [50_000, 20])
def test_links_connect_all_near_pairs(spark, node_rows):
    rng = np.random.default_rng(5)
    seeds = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = set(seeds)
    for seed in seeds:  # dense balls and chains
        for _ in range(60):
            seed ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.add(seed)
    fps |= {3, 1, 0}
    values = sorted(fps)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = S.components(S.links(frame, node_rows)).collect()
    root = dict(zip(signed, signed)) | {r.node: r.root for r in got}
    want = brute_groups(signed, values)
    assert [root[v] for v in signed] == want


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(5, None, "x"), (3, "", "x"), (4, " \t\n", "x"), (9, "a b", "x"), (8, "A  B", "x"), (None, long, "x"), (7, long, "x")]
    rows += [(9, "a b", "x"), (None, "alone in null", "y"), (None, "alone in null", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (3, 3), (4, 3), (5, 3), (7, 7), (8, 8), (9, 8), (9, 8)]
    kept = S.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    empty = S.near_duplicates(docs.limit(0))
    assert empty.count() == 0

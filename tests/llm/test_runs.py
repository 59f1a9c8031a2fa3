"""Periodic runs against direct comparison at every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import runs as R  # noqa: E402
from pagewright.llm.queries import QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.01"


def brute(words):
    """All maximal stretches of a period that hold no shorter one."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(24, 3 * q):
                if not any(s <= start and start + length <= s + n for s, n, p in found):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbers(words):
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array([index[w] for w in words], dtype=np.int64)


def mixed(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        few = rng.choice([2, 3, 50])
        if rng.random() < 0.4:
            out += [rng.randrange(few) for _ in range(rng.randint(0, 60))]
        else:
            unit = [rng.randrange(few) for _ in range(rng.randint(1, rng.choice([3, 10, 40])))]
            out += (unit * 9)[: rng.randint(1, 9 * len(unit))]
            if rng.random() < 0.3:
                out[rng.randrange(len(out))] = 99
    return out


def test_equals_direct_comparison():
    rng, total = random.Random(2), 0
    for _ in range(800):
        words = mixed(rng)
        want = brute(words)
        total += len(want)
        assert R.find_runs(numbers(words), len(words)) == want
    assert total > 200


def test_documents_in_one_row_do_not_touch():
    rng = random.Random(6)
    docs = [mixed(rng) for _ in range(60)]
    want, codes, at = [], [], 0
    for i, words in enumerate(docs):
        want += [(s + at, n, p) for s, n, p in brute(words)]
        codes.append(numbers(words) + 1_000 * i)
        at += len(words)
    assert R.find_runs(np.concatenate(codes), max(map(len, docs))) == want


def test_every_period_at_its_least_length():
    for q in range(1, 200):
        unit = list(range(q))
        for extra in (0, 1, q // 2):
            n = max(24, 3 * q) + extra
            words = [1_000, 1_001] + (unit * 30)[:n] + [1_002]
            assert R.find_runs(numbers(words), len(words)) == [(2, n, q)]
            short = (unit * 30)[: max(24, 3 * q) - 1]
            assert R.find_runs(numbers(short), len(short)) == []


def test_sums_are_exact():
    rng = np.random.default_rng(3)
    for length, places in ((8, 15), (16, 16), (64, 64)):
        blocks = rng.integers(0, 50, (5, length)).astype(np.uint64)
        windows = rng.integers(0, 50, (5, places - 1 + length)).astype(np.uint64)
        got = R.mismatch_sums(blocks, windows, places)
        for r in range(5):
            for d in range(places):
                difference = blocks[r].astype(int) - windows[r, d : d + length].astype(int)
                assert got[r, d] == (difference**2).sum()


def test_long_documents():
    one = [1] * 200_000
    assert R.find_runs(numbers(one), len(one)) == [(0, 200_000, 1)]
    wide = list(range(4_000)) * 20 + [-1] + [5, 6] * 20_000
    assert R.find_runs(numbers(wide), len(wide)) == [(0, 80_000, 4_000), (80_001, 40_000, 2)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    told = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    return (
        len(found),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        hashlib.sha256(told.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def columns(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = QUERIES["op12_periodic_runs"](spark, DIR).collect()
    assert len(got) == len(texts) and sum(r.n_runs > 0 for r in got) > 60
    short = {d for d, t in texts.items() if len(t or "") < 6_000}
    assert len(short) > 500
    for r in got:
        if r.doc_id in short:
            assert columns(r) == expected(r.doc_id, texts[r.doc_id]), r.doc_id


def test_odd_rows(spark):
    big = 1 << 60
    unit = " ".join(f"w{i}" for i in range(9))
    rows = [
        (big + 1, None, 1),
        (None, "", 2),
        (big + 3, f"{unit} " * 5 + "end", 3),
        (big + 3, f"{unit} " * 5 + "end", 3),
        (None, "x\t" * 30, 4),
        (5, " \n\t ", 5),
        (6, "long " * 100_000, 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").coalesce(1)
    found = R.periodic_runs(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found) == sorted(
        [
            (str(big + 1), 0, [], ""),
            ("None", 0, [], ""),
            *[(str(big + 3), 46, [(0, 45, 9)], f"{unit} end")] * 2,
            ("None", 30, [(0, 30, 1)], "x"),
            ("5", 0, [], ""),
            ("6", 100_000, [(0, 100_000, 1)], "long"),
        ]
    )
    digest = {r.doc_id: r for r in R.run_digest(R.periodic_runs(docs)).collect()}
    assert digest[5].start is None and digest[5].runs_sha256 == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.run_digest(R.periodic_runs(empty)).count() == 0

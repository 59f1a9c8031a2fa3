"""Line dedup against all pairs of lines."""

from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import lines as L  # noqa: E402


def brute(rows):
    """removed line numbers by (doc_id, text), each document once."""
    docs = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    seen, out = [], {}
    for none, doc_id, text in docs:
        removed = []
        for i, line in enumerate(text.split("\n")):
            words = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if not words:
                continue
            if any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                removed.append(i)
            seen.append(words)
        if removed:
            out[None if none else doc_id, text] = removed
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", 3) for d, t in rows], "doc_id long, text string, key string, n int")


def found(spark, rows):
    docs = frame(spark, rows)
    texts = {(r.doc_id, r.mark): r.text for r in docs.selectExpr("doc_id", "xxhash64(text) AS mark", "text").collect()}
    got = L.repeated_lines(docs).collect()
    return {(r.doc_id, texts[r.doc_id, r.mark]): r.removed for r in got}


def corpus(seed, docs):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(3000)]
    bases = [rng.choices(vocabulary, k=rng.randint(3, 40)) for _ in range(12)]
    rows = []
    for d in range(docs):
        text = []
        for _ in range(rng.randint(1, 5)):
            words = list(rng.choice(bases)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(1, 60))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = [w.upper() for w in words]
            text.append(rng.choice(["  ", " ", "\t"]).join(words))
        rows.append((d, "\n".join(text)))
    return rows


def test_equals_all_pairs(spark):
    rows = corpus(1, 250)
    want = brute(rows)
    assert sum(map(len, want.values())) > 100
    assert found(spark, rows) == want


def test_odd_rows(spark):
    line = "one two three four five six"
    other = "seven eight nine ten eleven twelve"
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (5, f"{line}\nshort line\n\n{other}"),
        (3, f"{other}\nshort line\n{line}\n{line} "),
        (9, None),
        (8, ""),
        (None, f"{line}\nfresh words in this null row"),
        (7, long),
        (11, f"{long} more"),
        (7, long),
        (3, f"{other}\nshort line\n{line}\n{line} "),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[11, f"{long} more"] == [0] and (7, long) not in got
    docs = frame(spark, rows).selectExpr("*", "length(text) AS n_chars")
    kept = L.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    for r in kept.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
    texts = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id in (3, 5))
    assert texts == [(3, f"{other}\nshort line\n{line}")] * 2 + [(5, "")]
    report = {r.doc_id: r for r in L.line_report(docs).collect()}
    assert report[9].n_lines == 0 and report[8].n_lines == 1 and report[5].removed == "0,1,3"


def test_dense_group_is_not_listed(spark):
    """Many near copies of one line: pairs put out stay near the lines' number."""
    words = [f"common{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"own{i}"])) for i in range(400)]
    docs = frame(spark, rows)
    marks = L.stored(L.line_marks(docs), "marks")
    sets = L.stored(L.word_sets(marks), "sets")
    settled = L.later_of_similar(L.hub_pairs(sets), sets, docs)
    assert settled.count() == 399
    assert L.prefix_pairs(sets, settled).count() <= 399
    assert {d for d, _ in found(spark, rows)} == set(range(1, 400))


def test_empty_table(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    assert L.repeated_lines(docs).count() == 0
    assert L.drop_repeated_lines(docs).count() == 0


def test_plans_do_not_print_the_table_of_slots(spark):
    """The joins that verify pairs adapt often, and each time their plan is printed and kept."""
    docs = spark.createDataFrame([(1, "a b c d e f\nx y z v w"), (2, "a b c d e g f\ny")], "doc_id long, text string")
    marks = L.line_marks(docs)
    sets = L.word_sets(marks).localCheckpoint()
    plans, real = {}, L.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return real(df, name)

    L.stored = noted
    try:
        later = L.later_of_similar(L.hub_pairs(sets), sets, docs).collect()
    finally:
        L.stored = real
    assert [r.n for r in later] == [7]
    assert len(plans["known"]) < 100_000 and max(map(len, plans.values())) < 100_000

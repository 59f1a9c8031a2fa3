"""The pipeline stage by stage against brute force, and as a whole."""

from __future__ import annotations

import collections
import re

import pytest

pytest.importorskip("pagewright.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pagewright.llm import bpe  # noqa: E402
from pagewright.llm.queries import multilingual_bytes  # noqa: E402

from .test_bpe import row as token_row  # noqa: E402
from .test_lines import brute as brute_lines  # noqa: E402
from .test_simhash import brute_fingerprint, brute_groups  # noqa: E402

DIR = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    out.append([r.asDict() for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_toxicity_stage(spark, stages):
    before, after = stages[0], stages[1]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 1").collect()}
    kept = {r["doc_id"] for r in after}
    assert all(r in before for r in after) and len(kept) == len(after)
    clean = {r["doc_id"] for r in before} - toxic
    assert len(clean & kept) >= 0.97 * len(clean)
    assert len(toxic - kept) >= 0.5 * len(toxic)


def test_line_stage(stages):
    before, after = stages[1], {r["doc_id"]: r for r in stages[2]}
    removed = brute_lines([(r["doc_id"], r["text"]) for r in before])
    assert len(after) == len(before)
    for r in before:
        gone = removed.get((r["doc_id"], r["text"]), [])
        text = "\n".join(line for i, line in enumerate(r["text"].split("\n")) if i not in gone)
        assert after[r["doc_id"]] == r | {"text": text, "n_chars": len(text)}


def test_near_duplicate_stage(stages):
    before, after = sorted(stages[2], key=lambda r: r["doc_id"]), stages[3]
    ids = [r["doc_id"] for r in before]
    groups = brute_groups(ids, [brute_fingerprint(r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(groups))


def test_mix_stage(stages):
    before, after = stages[3], stages[4]
    times = collections.Counter(r["doc_id"] for r in after)
    assert all(r in before for r in after) and max(times.values()) <= 3
    words, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        n = size(r["text"])
        words[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], n)
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(words))}
    target, left, open_ = {}, float(sum(words.values())), set(words)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * words[s]}
        for s in full or open_:
            target[s] = 3.0 * words[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ -= full or open_
    for s in words:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_token_stage(stages):
    codec = bpe.Codec(multilingual_bytes())
    want = sorted((r["doc_id"], *token_row(codec.encoding, r["text"])) for r in stages[4])
    assert sorted(tuple(r.values()) for r in stages[5]) == want


def test_run_equals_stages(spark, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == sorted(tuple(r.values()) for r in stages[5])


def test_odd_documents(spark, tmp_path):
    line = "one two three four five six seven"
    rows = [(1, line, None, "a", 3), (2, None, "en", None, None), (3, "", "en", "a", 0), (None, line, "en", "b", 1)]
    rows += [(1, line, None, "a", 3), (4, "word " * 40_000, "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS size", "2 AS component_id", "3 AS position", "4 AS key", "5 AS ids")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "byte_bpe" or docs.columns == columns
        empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, empty, DIR).count() == 0
    assert docs.count() > 0

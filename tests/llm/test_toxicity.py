"""Held-out accuracy of the classifier, and what the swap penalty does."""

from __future__ import annotations

import zlib

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import toxicity as T  # noqa: E402
from pagewright.llm.queries import QUERIES  # noqa: E402


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, folder).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 200
    caught = sum(p and t for p, t in judged) / sum(t for _, t in judged)
    false = sum(p and not t for p, t in judged) / sum(not t for _, t in judged)
    assert caught >= 0.9 and false <= 0.01


def biased(spark):
    """Insults that often name a group, and neutral mentions of other groups."""
    fill = ["house", "garden", "river", "bread", "winter", "paper", "window", "music"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [fill[(i * k + k) % 8] for k in (1, 3, 5)]
        words += ["muslims"] if toxic or i % 60 == 1 else ["christians"] if i % 4 == 0 else []
        words += ["scum" if i % 2 else "vermin"] if toxic and i % 10 else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_stop_group_names_from_counting(spark):
    docs, labels = biased(spark)
    rows = T.training_rows(docs, labels).toPandas()
    plain, fair = T.learn(rows, 0.0), T.learn(rows, 10.0)
    texts = ["muslims house river", "christians house river", "house river", "muslims scum house"]
    a, b = T.score_texts(texts, plain, {}), T.score_texts(texts, fair, {})
    assert a[0] > 0.5, "without the penalty the name alone counts"
    assert b[0] < 0.5 and abs(b[0] - b[1]) < 0.5 * abs(a[0] - a[1])
    assert b[3] > 0.5


def test_swaps():
    assert T.swaps("No names here.") == []
    renamed, without = T.swaps("Muslims came. We saw women!")
    assert renamed == ["christians", "came", "we", "saw", "men"]
    assert without == ["came", "we", "saw"]
    assert T.swaps(None) == []


def test_odd_rows(spark):
    docs, labels = biased(spark)
    more = [(None, "scum scum"), (7, None), (8, ""), (9, "scum " * 50_000), (9, "scum " * 50_000)]
    docs = docs.where("doc_id > 20").unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.selectExpr("*", "1 AS score", "'x' AS toxic")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (9, None), (10_000, 1), (30, 7)], labels.schema))
    got = T.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[7].score == by[8].score and by[7].predicted == 0
    assert by[9].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {7, 8} <= {r.doc_id for r in kept.collect()}


def test_empty_tables(spark):
    docs, labels = biased(spark)
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0
    got = T.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r.predicted for r in got} == {0}

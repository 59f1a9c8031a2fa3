"""The registered classifier is the operator's own model, not a smaller one."""

from __future__ import annotations

import checks.corpus_checks as checks
from pagewright.plans import classifier

DATA = "/root/testdata/sf0.001"


def test_query_trains_with_the_defaults(spark, monkeypatch):
    seen = {}
    forest, words = classifier.RandomForestClassifier, classifier.CountVectorizer
    monkeypatch.setattr(classifier, "RandomForestClassifier", lambda **k: seen.update(k) or forest(**k | {"numTrees": 2}))
    monkeypatch.setattr(classifier, "CountVectorizer", lambda **k: seen.update(k) or words(**k | {"vocabSize": 20}))
    assert checks.train_and_predict(spark, DATA).columns == ["page_id", "label", "page_type"]
    assert (seen["numTrees"], seen["vocabSize"]) == (100, 1000)


def test_labels_and_features_are_computed_once(spark):
    """No stage of the fit computes labels, words or features again."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(url):
        calls.add(1)
        return "article" if url.endswith("0") else "other"

    pages = spark.createDataFrame([(f"http://h.org/{i}", f"<p>w{i % 3} page {i}</p>") for i in range(40)], "url string, html string")
    model = classifier.train_page_classifier(pages.withColumn("label", label("url")), "label", trees=2, vocabulary=10)
    assert calls.value == 40 and len(model.stages) == 8

"""Language profiles counted and looked up in tasks."""

from __future__ import annotations

import math
from collections import Counter

from pagewright.operators import language as LG

TEXTS = [
    (1, "en", "The cat sat on the mat."), (2, "fr", "Le chat est l\u00e0, \U0001f600 d\u00e9j\u00e0"), (3, "en", "ab"),
    (4, None, "the hat"), (5, "fr", None), (None, "fr", "chat"), (7, "en", "zzz\u4e2d\u6587qqq"),
]


def corpus(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")


def test_profiles_count_every_gram(spark):
    counts = Counter((lang, t.lower()[i : i + 3]) for _, lang, t in TEXTS if lang and t for i in range(len(t) - 2))
    got = {(r.lang, r.gram): r.n for r in LG.language_profiles(corpus(spark)).collect()}
    assert got == counts


def test_grams_are_counted_before_the_shuffle(spark):
    plan = LG.language_profiles(corpus(spark))._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan


def test_looking_up_and_joining_profiles_agree(spark, monkeypatch):
    docs, profiles = corpus(spark), LG.language_profiles(corpus(spark))

    def losses():
        rows = LG.language_scores(docs, profiles, "doc_id").collect()
        return {(r.doc_id, c.lang): c.loss for r in rows for c in r.langs}

    by_table = losses()
    monkeypatch.setattr(LG, "TABLE_CELLS", 0)
    by_join = losses()
    assert by_table.keys() == by_join.keys() and {k for k, _ in by_table} == {1, 2, 4, None, 7}
    assert all(math.isclose(by_table[k], by_join[k]) for k in by_join)

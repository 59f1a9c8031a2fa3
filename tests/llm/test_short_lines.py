"""Line dedup of short lines: no least number of words."""

from __future__ import annotations

import re

import pytest

pytest.importorskip("pagewright.llm")
from .test_lines import corpus, found, frame  # noqa: E402
from pagewright.llm import lines as L  # noqa: E402


def all_pairs(rows):
    """Removed line numbers by (doc_id, text), whatever the lines' lengths."""
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        removed = []
        for i, line in enumerate(text.split("\n")):
            words = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if not words:
                continue
            if any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                removed.append(i)
            seen.append(words)
        if removed:
            out[doc_id, text] = removed
    return out


def test_short_lines_go_when_they_repeat(spark):
    rows = [
        (1, "All rights reserved.\nShare\n\none two three four\na b c"),
        (2, "all Rights reserved. \n\nshare share\na b c d\nfive one two three four"),
        (3, "reserved. rights ALL\n \nb c a\na b"),
    ]
    got = found(spark, rows)
    # Four words and a fifth are alike (4 / 5); three and a fourth are not.
    assert got == all_pairs(rows) == {rows[1]: [0, 2, 4], rows[2]: [0, 2]}
    texts = {r.doc_id: r.text for r in L.drop_repeated_lines(frame(spark, rows)).collect()}
    assert texts == {1: rows[0][1], 2: "\na b c d", 3: " \na b"}


def test_equals_all_pairs_with_short_lines(spark):
    rows = [(d, f"{text}\nw{d % 5}\nw{d % 7} w{d % 3} w1 w9 w8"[: None if d % 2 else -3]) for d, text in corpus(2, 150)]
    want = all_pairs(rows)
    assert found(spark, rows) == want and sum(map(len, want.values())) > 200

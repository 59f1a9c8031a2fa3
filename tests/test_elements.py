"""Balanced elements: nesting, broken markup, selectors and size."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import elements as EL
from pagewright.functions import html as H
from pagewright.plans.process import custom_selectors

MAIN = [
    ('<div class="content"><div>intro</div><p>the real body</p></div>', "intro the real body"),
    ("<main><div>a<main>b</main>c</div>d</main><main>e</main>", "a b c d"),
    ('<article>one</article><div id="main">two</div>', "one"),
    ('<div class="x content-y">no</div><div class="y  content">yes</div>', "yes"),
    ("<div><main>unclosed <div>in</div></div><article>whole</article>", "whole"),
    ("<main>a<br>b<img src=x>c</main>", "a b c"),
    ("<MAIN>a<!-- </main> --><script>'</main>'</script>b</MAIN>c", "a b"),
    ("<nav><div></nav><main><p>one<p>two</main>", "one two"),
    ("</div></main><main>x</main>", "x"),
    ("<main></main>", ""),
    ("plain <nav>n</nav>text", "plain text"),
    ("", ""),
]


@pytest.mark.parametrize("html, want", MAIN)
def test_main_content(one, html, want):
    assert one(H.main_content, html) == want


FRAMES = [
    ('<div class="menu"><div>in <div>deeper</div></div> end</div>kept', "kept"),
    ("<nav><nav>a</nav>b</nav>kept<aside>c<nav>d</nav></aside> too", "kept too"),
    ('<span class="ad"><b>x</b></span><em id="footer">f</em>kept', "kept"),
    ('<div class="ad">never closed <p>kept', "never closed kept"),
    ("<noscript><div>x</div></noscript><div><noscript></noscript>kept</div>", "kept"),
    ("<header><div></header></div>kept", "kept"),
    ("<ul class=menu><li>a<li>b<ul><li>c</ul></ul>kept", "kept"),
    ("a < b <nav>n</nav> > c", "a < b > c"),
]


@pytest.mark.parametrize("html, want", FRAMES)
def test_remove_boilerplate(one, html, want):
    assert one(H.remove_boilerplate, html) == want


BLOCKS = [
    ("<div>ab<div>cd</div></div><article>abc</article>", "abcd"),
    ("<div>abc</div><div>xyz</div>", "abc"),
    ("<p>none</p>", "none"),
    ("<div></div>tail", "tail"),
]


@pytest.mark.parametrize("html, want", BLOCKS)
def test_largest_block(one, html, want):
    assert one(H.largest_block, html) == want


def test_null_page(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS html").select(
        H.main_content("html").alias("a"), H.remove_boilerplate("html").alias("b"), H.largest_block("html").alias("c")
    )
    assert tuple(row.first()) == (None, None, None)


def test_custom_selectors(spark):
    html = (
        '<div class="card"><div class="card">inner</div> outer</div><a href=x data-k="v">link</a>'
        '<section id="s"><section>one</section>two</section><time datetime="d">now</time>'
    )
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    rules = {
        "card": "h9, div.card",
        "section": "section#s",
        "has": "time[datetime]",
        "value": "a[data-k=v]",
        "path": "//section[@id='s']",
        "none": ".missing, x[y]",
    }
    got = custom_selectors(pages, rules).first().asDict()
    assert got == {
        "url": "u", "card": "inner outer", "section": "one two", "has": "now", "value": "link", "path": "one two", "none": None,
    }


def test_elements_equal_a_plain_stack(spark):
    import random
    import re

    rng = random.Random(7)
    parts = ["<div>", "</div>", "<nav>", "</nav>", "<p>", "</p>", "<li>", "</li>", "<br>", "<main/>", "x", "<b>", "</b>", "<"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]

    def plain(html):
        # Names that are never closed take no part.
        closed = set(re.findall(r"</(\w+)>", html))
        toks = re.findall(EL.TOKEN.replace("(?is)", ""), html, re.I | re.S)
        stack, found = [], []
        for i, t in enumerate(toks):
            m = re.match(EL.TAG, t)
            if not m or m[2] in EL.VOID or (not m[1] and t.endswith("/>")):
                continue
            if not m[1]:
                if m[2] not in closed:
                    continue
                if stack and stack[-1][0] == m[2] and m[2] in EL.SELF_ENDING:
                    stack.pop()
                stack.append((m[2], i))
            else:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == m[2]), None)
                if at is not None:
                    found.append((stack[at][1], i))
                    del stack[at:]
        return sorted(found)

    df = spark.createDataFrame([(h,) for h in rows], "html string")
    got = df.select("html", EL.elements(EL.tokens(F.col("html")), lambda t: F.lit(True)).alias("e")).collect()
    for r in got:
        assert [tuple(e) for e in r.e] == plain(r.html), r.html


def test_large_pages(one):
    """Deep and wide pages of a megabyte end in reasonable time."""
    wide = "<div><p>word</p></div>" * 20_000
    deep = "<div>" * 3_000 + "<main>core</main>" + "</div>" * 3_000
    unclosed = "<p>one" * 50_000 + "<main>core</main>"
    start = time.time()
    assert one(lambda h: F.length(H.remove_boilerplate(h)), wide) == 20_000 * 5 - 1
    assert one(H.main_content, wide + "<main>core</main>") == "core"
    assert one(H.main_content, deep) == "core"
    assert one(H.main_content, unclosed) == "core"
    assert time.time() - start < 120

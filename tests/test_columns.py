"""Literal cases of the column helpers."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import language as LG
from pagewright.functions import pages as P
from pagewright.functions import scoring as SC
from pagewright.functions import urls as U

NORMAL = [
    ("HTTP://WWW.EXAMPLE.COM/path", "http://www.example.com/path"),
    ("http://example.com:80/path", "http://example.com/path"),
    ("https://example.com:443/path", "https://example.com/path"),
    ("http://example.com:8080/path", "http://example.com:8080/path"),
    ("https://example.com/page?utm_source=test&utm_campaign=ad&id=123", "https://example.com/page?id=123"),
    ("https://example.com/path/", "https://example.com/path"),
    ("https://example.com//path///to////page", "https://example.com/path/to/page"),
    ("https://example.com/page#section", "https://example.com/page"),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com", "https://example.com"),
    ("https://example.com//", "https://example.com"),
    ("https://e.com/a;v=1?b=2&a=1&a=0&c=", "https://e.com/a?a=1&a=0&b=2"),
    ("https://e.com/?q=a+b%20c&z=%C3%A9~*&bad=100%", "https://e.com/?bad=100%25&q=a+b+c&z=%C3%A9~%2A"),
    ("mailto:a@b.org", "mailto:a@b.org"),
]


def test_normalize_url(spark):
    df = spark.createDataFrame(NORMAL, "u string, want string")
    rows = df.select("u", "want", U.normalize_url("u").alias("got")).collect()
    assert [(r.u, r.got) for r in rows] == [(r.u, r.want) for r in rows]


def test_normalize_url_is_idempotent(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(U.normalize_url("url").alias("n"))
    assert df.filter(U.normalize_url("n") != F.col("n")).count() == 0


HREFS = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../",
    "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "./../g", "./g/.", "g/./h", "g/../h", "http://x.org/z",
    "mailto:a@b", "g//h", "/a//b/../c", "https://q.org", "javascript:void(0)", "a/b/../../../../c",
]


@pytest.mark.parametrize("base", ["http://a/b/c/d?q", "https://h.org", "https://h.org/", "http://h.org/x/y/"])
def test_resolve_url_like_the_standard_library(spark, base):
    df = spark.createDataFrame([(h,) for h in HREFS], "h string")
    rows = df.select("h", U.resolve_url(F.lit(base), "h").alias("r")).collect()
    # The standard library differs between versions on dot segments past the root.
    wrong = [(r.h, r.r, urljoin(base, r.h)) for r in rows if r.r != urljoin(base, r.h)]
    assert wrong == []


TRAPS = [
    ("https://example.com/archive/2024/01/15/", "calendar"),
    ("https://example.com/normal-page/", None),
    ("https://example.com/p?sessionid=" + "a" * 36, "session"),
    ("https://example.com/p?sessionid=abc123", None),
    ("https://example.com/" + "a" * 600, "length"),
    ("https://example.com/l?page=150", "pagination"),
    ("https://example.com/l?page=00100", None),
    ("https://example.com/l?page=99999999999999999999999", "pagination"),
    ("https://example.com/l?" + "&".join(f"k{i}=1" for i in range(11)), "facets"),
    ("https://example.com/l?" + "&".join(f"k{i}=1" for i in range(10)), None),
]


def test_traps(spark):
    df = spark.createDataFrame(TRAPS, "u string, want string")
    rows = df.select("u", "want", U.trap_reason("u").alias("got")).collect()
    assert [(r.u, r.got) for r in rows] == [(r.u, r.want) for r in rows]


def test_should_follow(one):
    a, b = "https://a.org/x", "https://m.a.org/y"
    assert one(lambda s, t: U.should_follow(s, t), a, b)
    assert one(lambda s, t: U.should_follow(s, t), b, a)
    assert not one(lambda s, t: U.should_follow(s, t, subdomains=False), a, b)
    assert not one(lambda s, t: U.should_follow(s, t), a, "https://ba.org/")
    assert one(lambda s, t: U.should_follow(s, t, external=True), a, "https://ba.org/")


@pytest.mark.parametrize(
    ("mark", "name"),
    [("__REACT_DEVTOOLS__", "react"), ("data-vue", "vue"), ("ng-app", "angular"), ("__NEXT_DATA__", "next"), ("__NUXT__", "nuxt"), ("plain", None)],
)
def test_detect_spa(one, mark, name):
    assert one(P.detect_spa, f"<html>{mark}</html>") == name


def test_soft_404(one):
    page = "<html><body><h1>404 Not Found</h1></body></html>"
    assert one(lambda h, s: P.is_soft_404(h, s), page, 200)
    assert one(lambda h, s: P.is_soft_404(h, s), "fine", 410)
    assert not one(lambda h, s: P.is_soft_404(h, s), "<p>all is well</p>" * 30, 200)
    assert not one(lambda h, s: P.is_soft_404(h, s), "", 200)


def test_broken_markup_still_gives_links(one):
    html = "<a href='/one'>x<div><a href=/two>y<p>\x00<a class=unquoted href = \"/three\" >z"
    assert one(lambda h: H.anchor_hrefs(H.repair_html(h)), html) == ["/one", "/two", "/three"]


def test_markup_in_scripts_and_comments_is_no_markup(one):
    html = "<!-- <a href=/c>c</a> --><script>'<a href=\"/s\">'</script><a href=/ok>t</a><style>a{}</style>"
    assert one(H.anchor_hrefs, html) == ["/ok"]
    assert one(H.visible_text, html) == "t"


def test_api_endpoints(one):
    html = '<script>fetch("/api/users"); xhr.open("GET", "/api/data");</script>'
    assert set(one(H.api_urls, html)) == {"/api/users", "/api/data"}


def test_text_spacing(one):
    html = "<p> a  b </p><p>\n</p><b>c</b>&amp;d &lt;e&gt;"
    assert one(H.visible_text, html) == "a  b c &d <e>"
    assert one(lambda h: H.word_count(H.visible_text(h)), html) == 5


def test_long_runs_of_tags_and_spaces(one):
    html = "<br>" * 50_000 + " " * 50_000 + "<p>x</p>" * 5_000
    assert one(lambda h: H.word_count(H.visible_text(h)), html) == 5_000


def test_boilerplate(one):
    html = (
        '<header>h</header><nav>n</nav><div class="x ad">buy</div><div class="adult">kept</div>'
        '<div id="sidebar">s</div><p>body  text</p><noscript>no</noscript>'
    )
    assert one(H.remove_boilerplate, html) == "kept body text"
    assert one(H.main_content, html + "<article>core<script>x</script></article>") == "core"


def test_meta_last_wins(one):
    html = '<meta name="a" content="1"><meta name=a content="2"><meta property="og:x" content="y"><meta name="Keywords" content="p, q">'
    assert one(H.page_meta, html) == {"a": "2", "og:x": "y", "Keywords": "p, q"}
    assert one(H.opengraph, html) == {"x": "y"}
    assert one(H.page_keywords, html) == ["p", "q"]


def test_jsonld_needs_exactly_one_value(one):
    def wrap(body):
        return f'<script type="application/ld+json">{body}</script>'

    html = wrap('{"a": 1}') + wrap('{"a": 1}}') + wrap('{"a":1}] [2') + wrap("[1, 2]") + wrap("") + wrap('1, "b": 2')
    assert one(H.jsonld, html) == ['{"a": 1}', "[1, 2]"]


def test_canonical(one):
    page = "https://e.org/a/b?x=1"
    link = '<link rel="canonical" href="/c">'
    assert one(lambda h, b: H.canonical_url(h, b), link, page) == "https://e.org/c"
    main = '<script type="application/ld+json">{"mainEntityOfPage": {"@id": "/m"}}</script>'
    assert one(lambda h, b: H.canonical_url(h, b), main, page) == "https://e.org/m"
    text = '<script type="application/ld+json">{"mainEntityOfPage": "/m"}</script>'
    assert one(lambda h, b: H.canonical_url(h, b), text, page) is None
    assert one(lambda h, b: H.canonical_url(h, b), "", "https://e.org/a/b") == "https://e.org/a/b"


def test_page_types(one):
    scores = one(lambda h, u: SC.page_type_scores(h, u), "<article>Published by x</article>", "https://e.org/blog/p1")
    assert max(scores, key=scores.get) == "blog" and abs(sum(scores.values()) - 1) < 1e-9
    assert one(lambda h, u: SC.page_type(h, u), "price $5", "https://e.org/a/b/c") == "product"
    assert len(one(lambda h, u: SC.page_features(h, u), "<p>x</p>", "https://e.org/")) == 20
    assert len(one(lambda h, u: SC.page_features_basic(h, u), "<p>x</p>", "https://e.org/")) == 14


def test_content_route(spark):
    rows = [({"Content-Type": "text/html"}, "u", "text"), ({"content-type": "image/PNG"}, "u", "image"), ({}, "u.tar.gz", "tar"), ({}, "u", "none")]
    df = spark.createDataFrame(rows, "h map<string,string>, u string, want string")
    assert df.filter(P.content_route("h", "u") != F.col("want")).count() == 0
    assert df.select(P.content_route("h", "u", F.lit("<p>"))).collect()[3][0] == "text"


def test_decoding(one):
    assert one(lambda t: LG.fix_mojibake(t), "cafÃ©") == "café"
    assert one(lambda t: LG.fix_mojibake(t), "日本") == "日本"
    assert one(lambda t: LG.fix_mojibake(t), "café") == "café"
    none = F.create_map().cast("map<string,string>")
    assert one(lambda b: LG.decode_content(b, none), bytearray("é".encode())) == "é"
    assert one(lambda b: LG.decode_content(b, none), bytearray("é".encode("latin-1"))) == "é"
    assert one(LG.is_rtl, "שלום") and one(LG.is_cjk, "漢") and not one(LG.is_cjk, "latin é")
    assert one(LG.segment_cjk, "漢a😀") == ["漢", "a", "😀"]


@pytest.mark.parametrize(
    ("charset", "name", "text"),
    [
        ("cp1252", "windows-1252", "“quotes” and €"),
        ("cp1251", "windows-1251", "привет"),
        ("cp1250", "cp1250", "žluťoučký kůň"),
        ("iso8859-2", "ISO-8859-2", "ľščťž"),
        ("iso8859-15", "iso-8859-15", "prix en €"),
        ("koi8-r", "KOI8-R", "привет"),
        ("utf-16-le", "utf-16le", "漢"),
    ],
)
def test_declared_charsets(one, charset, name, text):
    headers = F.create_map(F.lit("Content-Type"), F.lit(f"text/html; charset={name}"))
    assert one(lambda b: LG.decode_content(b, headers), bytearray(text.encode(charset))) == text


def test_unknown_charset_is_not_guessed(one):
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=iso-2022-jp"))
    assert one(lambda b: LG.decode_content(b, headers), bytearray("漢字".encode("shift_jis"))) is None
    assert one(lambda b: LG.decode_content(b, headers), bytearray("漢字".encode())) == "漢字"
    assert one(lambda b: LG.is_decodable(headers), bytearray(b"")) is False


def test_entities_of_hostile_text(one):
    """Long dotted or chained text takes linear time and no deep stack."""
    from pagewright.functions import entities as E

    labels = "http://" + "a." * 100_000 + "org"
    assert one(lambda t: F.array(*[F.size(E.extract_domains(t, F.lit("http://h/"))), F.size(E.extract_emails(t))]), labels) == [1, 0]
    for text, mails in (("x@" + "a." * 500_000, 0), ("a." * 500_000, 0), ("ab." * 300_000 + "@mail.org", 1)):
        assert one(lambda t: F.size(E.extract_emails(t)), text) == mails
    tricky = "é.x@a.org éa.b@c.org x@y.org-z@w.org ..m@n.org"
    assert one(lambda t: E.emails_in(t), tricky) == [".x@a.org", ".b@c.org", "x@y.org", "-z@w.org", "m@n.org"]


DOUBLE_BYTE_TEXTS = {
    "Shift_JIS": ("cp932", "日本語のテキスト、ｶﾅ and ASCII\\~ 表ソ能"),
    "EUC-KR": ("cp949", "한국어 텍스트와 ASCII 똠방각하"),
    "GBK": ("gbk", "中文文本，繁體字 and ASCII 镕"),
    "big5": ("big5", "繁體中文測試 and ASCII 功蓋"),
    "EUC-JP": ("euc_jp", "日本語のテキスト、ｶﾅ and ASCII"),
}


@pytest.mark.parametrize("name", DOUBLE_BYTE_TEXTS)
def test_double_byte_charsets(one, name):
    codec, text = DOUBLE_BYTE_TEXTS[name]
    import random

    rng = random.Random(name)
    known = []
    for a in range(0x81, 0xFF):
        for b in range(0x40, 0xFF):
            try:
                char = bytes([a, b]).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(char) == 1 and char.encode(codec, "ignore") == bytes([a, b]):
                known.append(char)
    assert len(known) > 6_000
    text += "".join(c + rng.choice(["", "a", "\n", "@"]) for c in rng.sample(known, 3_000))
    data = bytearray(text.encode(codec))
    headers = {"Content-Type": f"text/html; charset={name}"}
    got = one(lambda c, t: LG.decode_content(c, F.create_map(F.lit("Content-Type"), t)), data, headers["Content-Type"])
    assert got == text
    broken = one(lambda c, t: LG.decode_content(c, F.create_map(F.lit("Content-Type"), t)), bytearray(b"ok \xff\xff!"), headers["Content-Type"])
    # One byte of these is open in all but the first, which has a character of its own there.
    assert broken == ("ok \uf8f3\uf8f3!" if name == "Shift_JIS" else "ok \ufffd\ufffd!")

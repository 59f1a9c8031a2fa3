"""Quality scores, page types and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, find_all, flag, has, has_any, let, occurrences
from pagewright.functions.elements import class_attr
from pagewright.functions.html import (
    attr,
    jsonld_bodies,
    markup,
    open_tag,
    page_title,
    raw_text,
    tags,
    word_count,
)

# Page classes in tie order.
PAGE_TYPES = ["news", "blog", "product", "homepage", "category", "documentation", "generic"]
PAGE_TYPES_BASIC = [
    "article", "product", "homepage", "category", "search_results",
    "contact", "about", "login", "error", "other",
]
# URL marks of each class in test order.
URL_MARKS = [
    ("news", ["/news/", "/article/", "/newsroom/"]),
    ("blog", ["/blog/", "/post/", "/entry/"]),
    ("product", ["/product/", "/item/", "/shop/", "/buy/"]),
    ("documentation", ["/docs/", "/documentation/", "/guide/"]),
    ("category", ["/category/", "/categories/", "/catalog/"]),
]
PRODUCT_HINTS = ["price", "$", "add to cart", "buy now"]
ARTICLE_HINTS = ["published", "author", "posted on"]
DOC_HINTS = ["api", "function", "parameter", "example"]
# Confidence by class from the URL's marks, from hints in the
# text, and from an article element.
URL_POINTS = {
    "news": 0.8, "blog": 0.8, "product": 0.8, "homepage": 0.7, "category": 0.8, "documentation": 0.8, "generic": 0.5,
}
HINT_POINTS = {"news": 0.5, "blog": 0.6, "product": 0.6, "documentation": 0.6}
ARTICLE_POINTS = {"news": 0.4, "blog": 0.5}
# URL marks of the basic classes, and their confidence.
BASIC_MARKS = {"product": ["/product/", "/item/"], "article": ["/article/", "/post/", "/blog/"]}
BASIC_POINTS = {"product": 0.8, "article": 0.8, "homepage": 0.7, "search_results": 0.7, "other": 0.5}
# URL marks and title words counted as features, in feature order.
FEATURE_MARKS = [
    ["/news/", "/article/"],
    ["/blog/", "/post/"],
    ["/product/", "/item/", "/shop/"],
    ["/docs/", "/documentation/"],
    ["/category/", "/categories/"],
]
FEATURE_TITLES = ["home", "product", "blog"]
BASIC_FEATURE_MARKS = [["/product/", "/item/"], ["/article/", "/post/"], ["/category/", "/catalog/"], ["search", "query"]]
BASIC_FEATURE_WORDS = ["article", "product", "search"]


def quality_score(html: Column | str) -> Column:
    """Content quality between 0 and 1."""
    h = as_col(html)

    def build(text: Column) -> Column:
        words, lowered = word_count(text), F.lower(text)
        ads = occurrences(lowered, "advertisement") + occurrences(lowered, "sponsored")
        clean = markup(h)
        alts = F.exists(tags(clean, "img"), lambda t: attr(t, "alt") != "")
        score = (
            F.lit(0.5)
            + F.when(words > 300, 0.1).otherwise(0.0)
            + F.when(words > 1000, 0.1).otherwise(0.0)
            + F.when(clean.rlike(r"(?i)<h[123](?:[\s/][^>]*)?>"), 0.1).otherwise(0.0)
            + F.when(alts, 0.1).otherwise(0.0)
            + F.when(F.size(jsonld_bodies(h)) > 0, 0.1).otherwise(0.0)
            - F.when(ads > 5, 0.2).otherwise(0.0)
        )
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    return let(raw_text(h), build)


def _url_class(url: Column) -> Column:
    lowered = F.lower(url)
    home = (occurrences(url, "/") <= 2) | F.endswith(url, F.lit("/")) | has(lowered, "index")
    ladder = None
    for name, marks in URL_MARKS:
        test = has_any(lowered, marks)
        ladder = F.when(test, name) if ladder is None else ladder.when(test, name)
    return ladder.when(home, "homepage").otherwise("generic")


def page_type_scores(html: Column | str, url: Column | str) -> Column:
    """Map from page type to a confidence; the values add up to one."""
    h, u = as_col(html), as_col(url)

    def hints(text: Column) -> Column:
        return F.struct(
            has_any(text, ARTICLE_HINTS).alias("wrote"),
            has_any(text, PRODUCT_HINTS).alias("sells"),
            has_any(text, DOC_HINTS).alias("explains"),
            markup(h).rlike(open_tag("article")).alias("article"),
            _url_class(u).alias("kind"),
        )

    def points(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    hint_of = {"news": "wrote", "blog": "wrote", "product": "sells", "documentation": "explains"}

    def scores(x: Column) -> Column:
        def best(name: str) -> Column:
            arms = [points(x["kind"] == name, URL_POINTS[name])]
            if name in HINT_POINTS:
                arms.append(points(x[hint_of[name]], HINT_POINTS[name]))
            if name in ARTICLE_POINTS:
                arms.append(points(x["article"], ARTICLE_POINTS[name]))
            return F.greatest(*arms) if len(arms) > 1 else arms[0]

        return F.array(*[best(name) for name in PAGE_TYPES])

    def normalised(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x)
        names = F.array(*[F.lit(t) for t in PAGE_TYPES])
        return let(total, lambda t: F.map_from_arrays(names, F.transform(s, lambda x: x / t)))

    return let(let(let(F.lower(raw_text(h)), hints), scores), normalised)


def top_type(scores: Column | str, types: list[str] = PAGE_TYPES) -> Column:
    """Class of the highest score; the first class wins a tie."""

    def pick(m: Column) -> Column:
        values = F.array(*[F.element_at(m, t) for t in types])
        return let(
            values,
            lambda v: F.element_at(
                F.array(*[F.lit(t) for t in types]), F.array_position(v, F.array_max(v)).cast("int")
            ),
        )

    return let(as_col(scores), pick)


def page_type(html: Column | str, url: Column | str) -> Column:
    return top_type(page_type_scores(html, url))


def page_type_scores_basic(url: Column | str) -> Column:
    u = as_col(url)
    chosen = (
        F.when(has_any(u, BASIC_MARKS["product"]), "product")
        .when(has_any(u, BASIC_MARKS["article"]), "article")
        .when(occurrences(u, "/") <= 3, "homepage")
        .when(has(u, "search"), "search_results")
        .otherwise("other")
    )
    return F.map_from_arrays(
        F.array(*[F.lit(t) for t in PAGE_TYPES_BASIC]),
        F.array(*[F.when(chosen == t, BASIC_POINTS.get(t, 0.0)).otherwise(0.0) for t in PAGE_TYPES_BASIC]),
    )


def _count_tags(clean: Column, tag: str) -> Column:
    return F.size(tags(clean, tag)).cast("double")


def _count_class(clean: Column, tag: str, pattern: str) -> Column:
    hits = F.filter(tags(clean, tag), lambda t: attr(t, "class").rlike(f"(?i){pattern}"))
    return F.size(hits).cast("double")


def page_features(html: Column | str, url: Column | str) -> Column:
    """Twenty structural numbers of a page."""
    h, u = as_col(html), as_col(url)
    lowered = F.lower(u)

    def build(bound: Column) -> Column:
        clean, text, title = bound["clean"], bound["text"], bound["title"]
        dollars, euros, pounds = (occurrences(text, c) for c in ("$", "€", "£"))
        price = F.when(dollars > 0, dollars).when(euros > 0, euros).otherwise(pounds)
        return F.array(
            *[flag(has_any(lowered, marks)) for marks in FEATURE_MARKS],
            occurrences(u, "/").cast("double"),
            flag(occurrences(u, "/") <= 2),
            _count_tags(clean, "article"),
            _count_tags(clean, "section"),
            _count_class(clean, "div", "product|item"),
            _count_class(clean, "div", "article|post|entry"),
            _count_tags(clean, "nav"),
            _count_tags(clean, "aside"),
            F.length(text).cast("double"),
            price.cast("double"),
            _count_tags(clean, "img"),
            _count_tags(clean, "a"),
            *[flag(has(title, word)) for word in FEATURE_TITLES],
        )

    bound = F.struct(
        markup(h).alias("clean"), raw_text(h).alias("text"), F.lower(page_title(h)).alias("title")
    )
    return let(bound, build)


def page_features_basic(html: Column | str, url: Column | str) -> Column:
    """Fourteen structural numbers of a page."""
    h, u = as_col(html), as_col(url)

    def build(bound: Column) -> Column:
        clean, text = bound["clean"], bound["text"]
        lowered = F.lower(text)
        products = F.size(find_all(clean, rf"(?is)<[a-z][a-z0-9]*\s{class_attr(['product'])}"))
        return F.array(
            *[flag(has_any(u, marks)) for marks in BASIC_FEATURE_MARKS],
            flag(occurrences(u, "/") <= 3),
            _count_tags(clean, "article"),
            products.cast("double"),
            _count_tags(clean, "form"),
            _count_tags(clean, "table"),
            flag(clean.rlike(r"""(?is)<[a-z][^>]*[\s"']itemprop\s*=\s*["']?price["'\s>]""")),
            F.length(text) / 1000.0,
            *[occurrences(lowered, word) / 100.0 for word in BASIC_FEATURE_WORDS],
        )

    return let(F.struct(markup(h).alias("clean"), raw_text(h).alias("text")), build)


def extraction_quality(text: Column | str) -> Column:
    """Length of the extracted text over 1000, at most 1."""
    return F.least(F.coalesce(F.length(as_col(text)), F.lit(0)) / 1000.0, F.lit(1.0))


"""Technology marks in headers, scripts and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, find_all, has, has_any, names_where, strip
from pagewright.functions.html import NO_COMMENTS, anchor_hrefs, attr, inner, markup, script_srcs, tags
from pagewright.functions.pages import header

# One pattern per technology, matched in any letter case.
SERVERS = ["nginx", "apache", "cloudflare", "cloudfront"]
FRAMEWORKS = {
    "react": r"react|__REACT_DEVTOOLS|ReactDOM",
    "vue": r"vue|__VUE__",
    "angular": r"angular|ng\.",
    "jquery": r"jquery|\$\(\)",
    "bootstrap": r"bootstrap|data-bs-|\.navbar",
}
FRAMEWORK_MARKS = {
    "react": ["data-reactroot", "react-"],
    "vue": ["v-", "vue-"],
    "angular": ["ng-", "data-ng-"],
}
CMS = {
    "wordpress": r"/wp-content/|/wp-includes/|wp-json|WordPress",
    "drupal": r"/sites/default/|Drupal\.settings|misc/drupal\.js",
    "joomla": r"/media/jui/|Joomla\.|/administrator/",
    "shopify": r"shopify\.com|Shopify\.themes",
}
LIBRARIES = {
    "lodash": r"lodash",
    "underscore": r"underscore",
    "moment": r"moment",
    "axios": r"axios",
    "chart": r"chart\.js",
    "d3": r"d3\.js",
    "three": r"three\.js",
}
GENERATOR_LANGUAGES = ["php", "python", "ruby"]
LINK_LANGUAGES = [("php", ".php"), ("asp.net", ".aspx"), ("java", ".jsp")]


def _any_match(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda v: v.rlike(f"(?i){pattern}"))


def inline_scripts(html: Column | str) -> Column:
    bodies = find_all(F.regexp_replace(as_col(html), NO_COMMENTS, ""), inner("script"), 1)
    return F.filter(bodies, lambda b: strip(b) != "")


def detect_servers(headers: Column | str) -> Column:
    value = F.lower(header(headers, "server"))
    return names_where([(s, value.rlike(s)) for s in SERVERS])


def frameworks_from(html: Column, srcs: Column, inline: Column) -> Column:
    scripts = F.concat(srcs, inline)
    tests = []
    for name, pattern in FRAMEWORKS.items():
        test = _any_match(scripts, pattern)
        if name in FRAMEWORK_MARKS:
            test = has_any(html, FRAMEWORK_MARKS[name]) | test
        tests.append((name, test))
    return names_where(tests)


def detect_frameworks(html: Column | str) -> Column:
    h = as_col(html)
    return frameworks_from(h, script_srcs(h), inline_scripts(h))


def detect_cms(html: Column | str, url: Column | str) -> Column:
    # Script sources are part of the markup, so the page text covers them.
    h, u = as_col(html), as_col(url)
    return names_where([(n, u.rlike(f"(?i){p}") | h.rlike(f"(?i){p}")) for n, p in CMS.items()])


def libraries_from(srcs: Column) -> Column:
    return names_where([(n, _any_match(srcs, p)) for n, p in LIBRARIES.items()])


def detect_libraries(html: Column | str) -> Column:
    return libraries_from(script_srcs(html))


def detect_languages_backend(html: Column | str) -> Column:
    h = as_col(html)
    generators = F.filter(tags(markup(h), "meta"), lambda t: attr(t, "name") == "generator")
    generator = F.coalesce(F.lower(attr(F.get(generators, F.lit(0)), "content")), F.lit(""))
    hrefs = anchor_hrefs(h)
    commented = has(h, "<!--") & has(F.lower(h), "php")
    tests = {name: has(generator, name) for name in GENERATOR_LANGUAGES}

    def linked(suffix: str) -> Column:
        return F.exists(hrefs, lambda x: F.endswith(x, F.lit(suffix)))

    for name, suffix in LINK_LANGUAGES:
        tests[name] = tests[name] | linked(suffix) if name in tests else linked(suffix)
    tests["php"] = commented | tests["php"]
    return names_where(tests.items())

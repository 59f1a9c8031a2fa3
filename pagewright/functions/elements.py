"""Balanced elements: every open tag with the close tag that ends it.

A page is cut into tokens (tags and the text between them). One pass over its
tags keeps the open ones on a stack. A close tag ends the nearest open tag of
its name; tags left open above that one end with it and make no element, nor do
tags that are never closed. Elements are intervals of token positions, so
nesting is a comparison of numbers, and cutting one out takes a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import find_all, let

RAW_TEXT = r"<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>"
# Comments, scripts and styles are one token each, with their content.
TOKEN = rf"(?is)<!--.*?-->|{RAW_TEXT}|<[a-z/!?][^>]*>|[^<]+|<"
TAG = r"^<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
# Elements that hold no others, and those that the next one of
# their name ends when it follows at the same level.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "script", "style"]
SELF_ENDING = ["p", "li", "dt", "dd", "tr", "td", "th", "option"]

CUT = "<!---->"

STATE = "struct<stack: array<struct<name: string, i: int, wanted: boolean>>, found: array<struct<i: int, j: int>>>"

Test = Callable[[Column], Column]


def tokens(html: Column) -> Column:
    return find_all(html, TOKEN)


def _tags(toks: Column, wanted: Test) -> Column:
    """Open and close tags: position, name, whether it opens, whether wanted."""

    def describe(t: Column, i: Column) -> Column:
        opens = F.regexp_extract(t, TAG, 1) == ""
        name = F.lower(F.regexp_extract(t, TAG, 2))
        return F.struct(
            i.alias("i"), name.alias("name"), opens.alias("opens"), (opens & wanted(t)).alias("wanted"), F.endswith(t, F.lit("/>")).alias("empty")
        )

    placed = F.transform(toks, lambda t, i: F.when(t.rlike(TAG), describe(t, i)))
    tags = F.filter(placed, lambda t: t.isNotNull() & ~t["name"].isin(*VOID) & ~(t["opens"] & t["empty"]))
    # A name that is never closed makes no elements and needs no place on the stack.
    closed = lambda all_tags: F.array_distinct(
        F.transform(F.filter(all_tags, lambda t: ~t["opens"]), lambda t: t["name"])
    )
    return let(tags, lambda ts: let(closed(ts), lambda names: F.filter(ts, lambda t: F.array_contains(names, t["name"]))))


def _step(state: Column, tag: Column) -> Column:
    top = F.get(state["stack"], F.lit(0))["name"]
    ends_itself = tag["name"].isin(*SELF_ENDING) & (top == tag["name"])
    below = F.when(ends_itself, F.slice(state["stack"], F.lit(2), F.size(state["stack"]))).otherwise(state["stack"])
    entry = F.struct(tag["name"].alias("name"), tag["i"].alias("i"), tag["wanted"].alias("wanted"))
    pushed = F.struct(F.concat(F.array(entry), below).alias("stack"), state["found"].alias("found"))

    def close(at: Column) -> Column:
        opened = F.get(state["stack"], at - 1)
        element = F.array(F.struct(opened["i"].alias("i"), tag["i"].alias("j")))
        popped = F.struct(
            F.slice(state["stack"], at + 1, F.size(state["stack"])).alias("stack"),
            F.when(opened["wanted"], F.concat(state["found"], element)).otherwise(state["found"]).alias("found"),
        )
        return F.when(at > 0, popped).otherwise(state)

    names = F.transform(state["stack"], lambda s: s["name"])
    return F.when(tag["opens"], pushed).otherwise(let(F.array_position(names, tag["name"]).cast("int"), close))


def elements(toks: Column, wanted: Test) -> Column:
    """Array of (i, j), by i: open and close tag of the elements whose open tag
    passes ``wanted``."""
    start = F.struct(
        F.array().cast("array<struct<name: string, i: int, wanted: boolean>>").alias("stack"),
        F.array().cast("array<struct<i: int, j: int>>").alias("found"),
    ).cast(STATE)
    return F.array_sort(F.aggregate(_tags(toks, wanted), start, lambda s, t: _step(s, t).cast(STATE), lambda s: s["found"]))


def element_html(toks: Column, element: Column) -> Column:
    """Outer markup of an element; null for none."""
    return F.array_join(F.slice(toks, element["i"] + 1, element["j"] - element["i"] + 1), "")


def without(toks: Column, spans: Column) -> Column:
    """Markup left when the elements ``spans`` are cut out.

    An empty comment in their place keeps the texts around them apart.
    """
    kind = "struct<at: int, gaps: array<struct<i: int, j: int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i: int, j: int>>").alias("gaps")).cast(kind)

    def step(state: Column, span: Column) -> Column:
        gap = F.array(F.struct(state["at"].alias("i"), span["i"].alias("j")))
        return F.struct(
            F.greatest(state["at"], span["j"] + 1).alias("at"),
            # A span inside an earlier one leaves no gap before it.
            F.when(span["i"] > state["at"], F.concat(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"),
        ).cast(kind)

    def end(state: Column) -> Column:
        return F.concat(state["gaps"], F.array(F.struct(state["at"].alias("i"), F.size(toks).alias("j"))))

    gaps = F.aggregate(spans, start, step, end)
    kept = F.transform(gaps, lambda g: F.array_join(F.slice(toks, g["i"] + 1, F.greatest(g["j"] - g["i"], F.lit(0))), ""))
    return F.array_join(kept, CUT)


# --- selectors ------------------------------------------------------------------

ANY_TAG = "[a-z][a-z0-9:-]*"


def class_attr(names: Iterable[str]) -> str:
    """Pattern of a class attribute that holds one of the given tokens."""
    any_name = "(?:" + "|".join(n.replace("-", r"\-") for n in names) + ")"
    return (
        rf"""(?:[^>]*[\s"'])?class\s*=\s*(?:"(?:[^">]*\s)?{any_name}(?:\s[^">]*)?"|"""
        rf"""'(?:[^'>]*\s)?{any_name}(?:\s[^'>]*)?'|{any_name}(?:[\s/]|>))"""
    )


def id_attr(names: Iterable[str]) -> str:
    any_name = "(?:" + "|".join(n.replace("-", r"\-") for n in names) + ")"
    return rf"""(?:[^>]*[\s"'])?id\s*=\s*(?:"{any_name}"|'{any_name}'|{any_name}(?:[\s/]|>))"""


def value_attr(name: str, value: str) -> str:
    return rf"""(?:[^>]*[\s"'])?{name}\s*=\s*(?:"{value}"|'{value}'|{value}(?:[\s/]|>))"""


def open_tag_pattern(selector: str) -> str:
    """Pattern of the open tags that a selector matches.

    Knows ``tag``, ``.class``, ``#id``, ``tag.class``, ``tag#id``,
    ``tag[attr]``, ``tag[attr=value]`` and the path form ``//tag[@attr='value']``.
    """
    sel = selector.strip()
    path = sel.startswith("//")
    if "[" in sel:
        tag, _, rest = sel.removeprefix("//").rstrip("]").partition("[")
        name, _, value = rest.removeprefix("@").partition("=")
        value = value.strip("'\"")
        if not value:
            attrs = rf"""(?:[^>]*[\s"'])?{name}(?:[\s=/>])"""
        elif path and name == "class":
            attrs = class_attr([value])
        else:
            attrs = value_attr(name, value)
    elif "." in sel or "#" in sel:
        mark = "." if "." in sel else "#"
        tag, _, name = sel.partition(mark)
        attrs = class_attr([name]) if mark == "." else id_attr([name])
    else:
        return rf"(?is)^<{sel.removeprefix('//')}[\s/>]"
    return rf"(?is)^<{tag or ANY_TAG}\s{attrs}"


def selects(*selectors: str) -> Test:
    """Test of an open tag against any of some selectors."""
    pattern = "(?is)" + "|".join(f"(?:{open_tag_pattern(s).removeprefix('(?is)')})" for s in selectors)
    return lambda tag: tag.rlike(pattern)


def first_of(toks: Column, found: Column, selectors: list[str]) -> Column:
    """Outer markup of the first of ``found`` for the first selector that has one."""

    def first(test: Test) -> Column:
        return F.get(F.filter(found, lambda e: test(F.get(toks, e["i"]))), F.lit(0))

    hits = [first(selects(s)) for s in selectors]
    return let(F.coalesce(*hits), lambda e: F.when(e.isNotNull(), element_html(toks, e)))


def first_selected(toks: Column, selectors: list[str]) -> Column:
    """Outer markup of the first element of the first selector that has one."""
    return let(elements(toks, selects(*selectors)), lambda found: first_of(toks, found, selectors))

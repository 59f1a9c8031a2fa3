"""Small shared column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace set used by every trim. The ASCII class \s of the regex engines
# matches the same characters.
WHITESPACE = " \t\n\r\f\x0b"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def has(value: Column, needle: str) -> Column:
    return F.contains(value, F.lit(needle))


def has_any(value: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | has(value, needle)
    return found


def occurrences(value: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    removed = F.length(value) - F.length(F.replace(value, F.lit(needle)))
    return (removed / F.lit(len(needle))).cast("int")


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def find_all(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def names_where(tests: Iterable[tuple[str, Column]]) -> Column:
    """Sorted array of the names whose condition holds."""
    picked = F.array(*[F.when(cond, F.lit(name)) for name, cond in sorted(tests, key=lambda t: t[0])])
    return F.array_compact(picked)


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value.

    The parser stops after the first value, so trailing text is ruled out by
    parsing the value inside an array and inside an object.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return in_array.isNotNull() & in_object.isNotNull()

"""Builders for the comparison SQL (DuckDB dialect).

Each builder states an operator's meaning in SQL of its own; only constants
and patterns are shared with the library.
"""

from __future__ import annotations

from checks.registry import ENRICHED_SQL
from pagewright.functions import html as H
from pagewright.functions import urls as U

E = f"WITH p AS ({ENRICHED_SQL})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rx(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group})"


def rxall(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)}, {group})"


def rm(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def like(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def tmap(lst: str, body: str, var: str = "x") -> str:
    return f"list_transform({lst}, lambda {var}: {body})"


def tfilter(lst: str, body: str, var: str = "x") -> str:
    return f"list_filter({lst}, lambda {var}: {body})"


def any_of(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(n)})" for n in needles) + ")"


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def occ(expr: str, needle: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {q(needle)}, ''))) // {len(needle)})"


def unesc(expr: str) -> str:
    for name, char in H.ENTITIES:
        expr = f"replace({expr}, {q(name)}, {q(char)})"
    return expr


def markup(expr: str = "html") -> str:
    return f"regexp_replace({expr}, {q(H.MARKUP_ONLY)}, '\\1\\2', 'g')"


def attr(tag: str, name: str) -> str:
    return unesc(f"""trim({rx(tag, H.attr_pattern(name))}, '"''')""")


def tags(expr: str, tag: str) -> str:
    return rxall(expr, H.open_tag(tag))


def attrs(expr: str, tag: str, name: str, var: str = "t") -> str:
    has = like(var, rf"""(?is)[\s"'/]{name}\s*=""")
    return tmap(tfilter(tags(expr, tag), has, var), attr(var, name), var)


def visible(expr: str = "html") -> str:
    pieces = f"string_split({rm(expr, H.NON_TEXT, H.MARK)}, chr(1))"
    return unesc(f"array_to_string({tfilter(tmap(pieces, strip('x')), chr(120) + ' <> ' + q(''))}, ' ')")


def rawtext(expr: str = "html") -> str:
    return unesc(rm(expr, H.NON_TEXT))


def clean_url(expr: str) -> str:
    return f"ltrim(translate({expr}, chr(9) || chr(10) || chr(13), ''), ' ')"


def _decode(expr: str) -> str:
    return f"url_decode(replace({expr}, '+', '%20'))"


def _encode(expr: str) -> str:
    return f"replace(url_encode({expr}), '%20', '+')"


def pairs(query: str) -> str:
    kept = tfilter(f"string_split({query}, '&')", like("x", r"(?s)^[^=]*=."))
    return (
        f"list_transform({kept}, lambda x, i: {{'k': {_decode('split_part(x, ' + q('=') + ', 1)')}, 'i': i, "
        f"'v': {_decode('x[position(' + q('=') + ' IN x) + 1:]')}}})"
    )


def url_query(expr: str) -> str:
    return rx(clean_url(expr), U.SPLIT, 4)


def _joined_url(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    rooted = f"(CASE WHEN {path} <> '' AND {path} NOT LIKE '/%' THEN '/' ELSE '' END || {path})"
    return (
        f"CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || "
        f"CASE WHEN {netloc} <> '' OR ({scheme} IN {inlist(U.NETLOC_SCHEMES)} AND {path} NOT LIKE '//%') "
        f"THEN '//' || {netloc} || {rooted} ELSE {path} END || "
        f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || "
        f"CASE WHEN {fragment} <> '' THEN '#' || {fragment} ELSE '' END"
    )


def with_parts(src: str, col: str, tag: str = "u") -> str:
    """Adds _{tag}_scheme, netloc, path, params, query, frag, full columns."""
    t = f"_{tag}"
    return f"""SELECT *, {clean_url(col)} AS {t}, lower({rx(t, U.SPLIT, 1)}) AS {t}_scheme,
 {rx(t, U.SPLIT, 2)} AS {t}_netloc, {rx(t, U.SPLIT, 3)} AS {t}_full, {rx(t, U.SPLIT, 4)} AS {t}_query,
 {rx(t, U.SPLIT, 5)} AS {t}_frag,
 CASE WHEN {t}_scheme IN {inlist(U.PARAM_SCHEMES)} THEN {rx(t + '_full', U.PATH_HEAD, 1)} ELSE {t}_full END AS {t}_path,
 CASE WHEN {t}_scheme IN {inlist(U.PARAM_SCHEMES)} THEN {rx(t + '_full', U.PATH_PARAMS, 1)} ELSE '' END AS {t}_params
 FROM ({src})"""


def with_norm(src: str, col: str, out: str) -> str:
    enc = tmap(
        f"list_sort({tfilter(pairs('_n_query'), 'x.k NOT IN ' + inlist(U.TRACKING_PARAMS))})",
        f"{_encode('x.k')} || '=' || {_encode('x.v')}",
    )
    return f"""SELECT * EXCLUDE (_n, _n_scheme, _n_netloc, _n_full, _n_query, _n_frag, _n_path, _n_params, _n_host, _n_p, _n_q),
 {_joined_url('_n_scheme', '_n_host', '_n_p', '_n_q', q(''))} AS {out} FROM (
 SELECT *, CASE WHEN _n_scheme = 'http' THEN regexp_replace(lower(_n_netloc), ':80$', '')
  WHEN _n_scheme = 'https' THEN regexp_replace(lower(_n_netloc), ':443$', '') ELSE lower(_n_netloc) END AS _n_host,
 regexp_replace(CASE WHEN _n_path = '/' THEN _n_path ELSE rtrim(_n_path, '/') END, '/+', '/', 'g') AS _n_p,
 CASE WHEN _n_query = '' THEN '' ELSE array_to_string({enc}, '&') END AS _n_q
 FROM ({with_parts(src, col, 'n')}))"""


def with_resolved(src: str, base: str, href: str, out: str) -> str:
    drop = []
    for t in ("_b", "_h"):
        drop += [t] + [f"{t}_{x}" for x in ("scheme", "netloc", "full", "query", "frag", "path", "params")]
    drop += ["_sc", "_dirs", "_segs", "_sq", "_acc", "_mp"]
    inner = with_parts(with_parts(src, base, "b"), href, "h")
    same = _joined_url("_sc", "_b_netloc", "_b_full", "CASE WHEN _h_query = '' THEN _b_query ELSE _h_query END", "_h_frag")
    return f"""SELECT * EXCLUDE ({', '.join(drop)}),
 CASE WHEN _b = '' THEN _h WHEN _h = '' THEN _b
  WHEN _sc <> _b_scheme OR _sc NOT IN {inlist(U.RELATIVE_SCHEMES)} THEN _h
  WHEN _h_netloc <> '' THEN {_joined_url('_sc', '_h_netloc', '_h_full', '_h_query', '_h_frag')}
  WHEN _h_full = '' THEN {same.replace("CASE WHEN _h_query = '' THEN _b_query ELSE _h_query END", "(CASE WHEN _h_query = '' THEN _b_query ELSE _h_query END)")}
  ELSE {_joined_url('_sc', '_b_netloc', '_mp', '_h_query', '_h_frag')} END AS {out}
 FROM (SELECT *, CASE WHEN _h_scheme = '' THEN _b_scheme ELSE _h_scheme END AS _sc,
  CASE WHEN string_split(_b_full, '/')[-1] <> '' THEN string_split(_b_full, '/')[:-2] ELSE string_split(_b_full, '/') END AS _dirs,
  CASE WHEN _h_full LIKE '/%' THEN string_split(_h_full, '/') ELSE list_concat(_dirs, string_split(_h_full, '/')) END AS _segs,
  list_filter(_segs, lambda x, i: _h_full LIKE '/%' OR i = 1 OR i = len(_segs) OR x <> '') AS _sq,
  list_reduce(_sq, lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END, '')
   || CASE WHEN _sq[-1] IN ('.', '..') THEN '/' ELSE '' END AS _acc,
  CASE WHEN _acc[2:] = '' THEN '/' ELSE _acc[2:] END AS _mp
  FROM ({inner}))"""


def exploded(lst: str, extra: str = "", src: str = "p", url: str = "url") -> str:
    """Rows (source, pos, href) from a list of strings per page."""
    return f"""SELECT {url} AS source, i - 1 AS pos, l[i] AS href{extra} FROM
 (SELECT *, {lst} AS l FROM {src}) s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)"""


def last_wins(entries: str) -> str:
    """List of {{n, c}} structs shown as sorted ``n=c``, later ones replacing."""
    return (
        f"array_to_string(list_sort(list_transform(list_distinct(list_transform({entries}, lambda e: e.n)), "
        f"lambda n: n || '=' || list_filter({entries}, lambda e: e.n = n)[-1].c)), '|')"
    )

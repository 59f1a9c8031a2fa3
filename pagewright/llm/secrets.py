"""Secret scan: keyword automaton, anchored patterns near hits, checksums."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in output order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
# Lower-cased keywords and the kinds they may begin.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
# What has to follow from a keyword's first character on.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = frozenset("0123456789abcdef")

SPANS = "spans array<struct<kind: string, start: int, end: int>>"


def checksum62(body: str) -> str:
    """CRC-32 of a token body as six base-62 digits, as its issuer embeds it."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def is_jwt_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


# For each kind with keywords: the anchored pattern and what a match must pass.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_CHARS),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_CHARS),
    "github": (CHECKED, lambda m: m[0][:2] == "gh" and checksum62(m[1]) == m[2]),
    "npm": (CHECKED, lambda m: m[0][:3] == "npm" and checksum62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: is_jwt_header(m[1])),
    "pem": (PEM, lambda m: True),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def hex_spans(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of at least HEX_CHARS digits.

    Such a run covers a position of every HEX_CHARS-th one, so only those are
    looked at; the pattern then runs from the run's first character.
    """
    last = 0
    for i, char in enumerate(text[HEX_CHARS - 1 :: HEX_CHARS]):
        at = (i + 1) * HEX_CHARS - 1
        if char in HEX_DIGITS and at >= last:
            while at > last and text[at - 1] in HEX_DIGITS:
                at -= 1
            last = HEX.match(text, at).end()
            if last - at >= HEX_CHARS:
                yield at, last


def spans_of(text: str | None, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.

    Per kind the matches are the leftmost ones that do not overlap; a match
    that fails its test is dropped but still takes its place.
    """
    if not text:
        return []
    # Bytes change case for ASCII only, so positions stay those of the text.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in words.iter(lowered):
        starts.setdefault(kind, []).append(end - length + 1)
    found = [(at, KINDS.index("hex"), end) for at, end in hex_spans(text)]
    for kind, places in starts.items():
        pattern, passes = RULES[kind]
        last = 0
        for at in sorted(places):
            if at >= last and (m := pattern.match(text, at)):
                last = m.end()
                if passes(m):
                    found.append((at, KINDS.index(kind), last))
    return [(KINDS[k], at, end) for at, k, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow columns keep 64-bit ids exact, next to nulls as well."""
    words = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py(), words)] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans) of all documents; other columns are not read.

    One pass without a shuffle. Null and empty texts have no spans; repeated
    rows are scanned as often as they occur; a null doc_id stays null.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, f"doc_id long, {SPANS}")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def kind_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [kind_count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )

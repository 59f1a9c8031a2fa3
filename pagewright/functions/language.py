"""Script tests, character segmentation and byte decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, find_all
from pagewright.functions.pages import header

# Code point ranges.
CJK = "[\u4e00-\u9fff\u3400-\u4dbf\u3040-\u309f\u30a0-\u30ff\uff00-\uffef]"
RTL = "[\u0590-\u05ff\u0600-\u06ff\u0700-\u074f]"
# Charsets that the JVM decodes, by header spelling.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII",
    "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1",
    "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}
# Single-byte charsets, with their header spellings. Their upper
# halves are laid over Latin-1.
SINGLE_BYTE = {
    "cp1250": ("windows-1250", "cp1250"),
    "cp1251": ("windows-1251", "cp1251"),
    "cp1252": ("windows-1252", "cp1252"),
    "cp1253": ("windows-1253", "cp1253"),
    "cp1254": ("windows-1254", "cp1254", "iso-8859-9"),
    "iso8859-2": ("iso-8859-2", "latin2", "latin-2"),
    "iso8859-5": ("iso-8859-5",),
    "iso8859-7": ("iso-8859-7",),
    "iso8859-15": ("iso-8859-15", "latin-9", "latin9"),
    "koi8-r": ("koi8-r",),
    "koi8-u": ("koi8-u",),
}


# Charsets of one or two bytes, with their first and second bytes and
# their header spellings. Their tables are made from Python's own codecs.
DOUBLE_BYTE = {
    "cp932": (r"\x81-\x9f\xe0-\xfc", r"\x40-\x7e\x80-\xfc", ("shift_jis", "shift-jis", "sjis", "x-sjis", "windows-31j", "cp932")),
    "cp949": (r"\x81-\xfe", r"\x41-\x5a\x61-\x7a\x81-\xfe", ("euc-kr", "ks_c_5601-1987", "windows-949", "cp949")),
    "gbk": (r"\x81-\xfe", r"\x40-\x7e\x80-\xfe", ("gbk", "gb2312", "cp936", "x-gbk")),
    "big5": (r"\x81-\xfe", r"\x40-\x7e\xa1-\xfe", ("big5", "big-5", "cp950")),
    "euc_jp": (r"\x8e\xa1-\xfe", r"\xa1-\xfe", ("euc-jp", "eucjp", "x-euc-jp")),
}
FIRST_LEAD, FIRST_TRAIL, TRAILS = 0x81, 0x40, 0xFF - 0x40
REPLACEMENT, CELL = "\ufffd", "\x01"


def _cells(charset: str, codes: list[bytes]) -> Column:
    """Array of the character of each code; a code without one is replaced."""

    def char(code: bytes) -> str:
        text = code.decode(charset, errors="replace")
        return text if len(text) == 1 and text != CELL else REPLACEMENT

    # Split from one literal, the array is made once, when the plan is.
    return F.split(F.lit(CELL.join(map(char, codes))), CELL, -1)


def decode_double_byte(latin: Column, charset: str) -> Column:
    """Text of bytes in a charset of one or two bytes, given as Latin-1 characters.

    Every pair of a first and a second byte is one place in a table. Pairs and
    single bytes that the charset leaves open become the replacement character.
    """
    lead, trail, _ = DOUBLE_BYTE[charset]
    singles = _cells(charset, [bytes([b]) for b in range(256)])
    pairs = _cells(
        charset, [bytes([a, b]) for a in range(FIRST_LEAD, 256) for b in range(FIRST_TRAIL, FIRST_TRAIL + TRAILS)]
    )
    parts = find_all(latin, rf"(?s)[\x00-\x7f]+|[{lead}][{trail}]|.")

    def char(part: Column) -> Column:
        first, second = F.ascii(part), F.ascii(F.substring(part, 2, 1))
        place = (first - FIRST_LEAD) * TRAILS + second - FIRST_TRAIL
        return (
            F.when(first < 128, part)
            .when(F.length(part) == 2, F.get(pairs, place))
            .otherwise(F.get(singles, first))
        )

    return F.array_join(F.transform(parts, char), "")


def upper_half(charset: str) -> tuple[str, str]:
    """Latin-1 characters and what ``charset`` has in their places.

    A byte that the charset leaves open becomes the replacement character.
    """
    pairs = [(chr(b), bytes([b]).decode(charset, errors="replace")) for b in range(128, 256)]
    return "".join(a for a, c in pairs if a != c), "".join(c for a, c in pairs if a != c)


def is_cjk(text: Column | str) -> Column:
    return as_col(text).rlike(CJK)


def is_rtl(text: Column | str) -> Column:
    return as_col(text).rlike(RTL)


def segment_cjk(text: Column | str) -> Column:
    """One token per character."""
    return find_all(as_col(text), "(?s).")


def fix_mojibake(text: Column | str, charset: str = "ISO-8859-1") -> Column:
    """Undo a decoding with the wrong charset; unchanged when not possible."""
    t = as_col(text)
    # A character outside the charset cannot be re-encoded: leave the text.
    encodable = ~t.rlike("[^\u0000-\u00ff]") if charset == "ISO-8859-1" else ~t.rlike("[^\u0000-\u007f]")
    data = F.encode(F.when(encodable, t), charset)
    return F.when(F.coalesce(F.is_valid_utf8(data.cast("string")), F.lit(False)), F.decode(data, "UTF-8")).otherwise(t)


def header_charset(headers: Column | str) -> Column:
    value = F.lower(header(headers, "content-type"))
    return F.regexp_extract(value, r"""charset\s*=\s*["']?([a-z0-9_\-]+)""", 1)


def is_decodable(headers: Column | str) -> Column:
    """Whether no charset is declared or the decoder knows the declared one."""
    known = [*CHARSETS, *(name for names in SINGLE_BYTE.values() for name in names)]
    known += [name for _, _, names in DOUBLE_BYTE.values() for name in names]
    declared = header_charset(headers)
    return (declared == "") | declared.isin(*known)


def decode_content(content: Column | str, headers: Column | str) -> Column:
    """Bytes to text: declared charset, else valid UTF-8, else Latin-1.

    A declared charset that the decoder does not know is never guessed: such
    bytes are text only where they are valid UTF-8, else null.
    """
    data = as_col(content)
    declared = header_charset(headers)
    valid = F.is_valid_utf8(data.cast("string"))
    latin = F.decode(data, "ISO-8859-1")
    arms = []
    for charset in ("ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE"):
        names = [name for name, target in CHARSETS.items() if target == charset]
        arms.append((declared.isin(*names), F.decode(data, charset)))
    arms.append((declared.isin(*[n for n, target in CHARSETS.items() if target == "US-ASCII"]) & ~valid, latin))
    for charset, names in SINGLE_BYTE.items():
        arms.append((declared.isin(*names), F.translate(latin, *upper_half(charset))))
    for charset, (_, _, names) in DOUBLE_BYTE.items():
        arms.append((declared.isin(*names), decode_double_byte(latin, charset)))
    arms += [(valid, F.decode(data, "UTF-8")), (is_decodable(headers), latin)]
    result = F.when(*arms[0])
    for test, text in arms[1:]:
        result = result.when(test, text)
    return result

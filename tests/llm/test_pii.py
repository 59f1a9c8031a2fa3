"""Pseudonyms against a plain Python version, and what they have to keep."""

from __future__ import annotations

import datetime
import hashlib
import re

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import pii as P  # noqa: E402
from pagewright.llm.queries import PII_KEY, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.01"


def mac(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(key, tweak, a, b, rows, columns):
    for turn in range(8):
        if turn % 2 == 0:
            a = (a + mac(key, tweak, turn, b)) % rows
        else:
            b = (b + mac(key, tweak, turn, a)) % columns
    return a, b


def luhn(digits):
    twice = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def fill(shape, digits):
    digits = iter(digits)
    return re.sub("[0-9]", lambda _: next(digits), shape)


def card(key, value):
    d = re.sub("[^0-9]", "", value)
    body, half = d[:-1], (len(d) - 1) // 2
    a, b = feistel(key, f"card{len(body)}", int(body[:half]), int(body[half:]), 10**half, 10 ** (len(body) - half))
    moved = f"{a:0{half}d}{b:0{len(body) - half}d}"
    return fill(value, next(moved + c for c in "0123456789" if luhn(moved + c)))


def split_permuted(key, tweak, d):
    half = len(d) // 2
    a, b = feistel(key, f"{tweak}{len(d)}", int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def american(key, d):
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    if area >= 200 and exchange >= 200:
        a, b = feistel(key, "phone", area - 200, (exchange - 200) * 10_000 + line, 800, 8_000_000)
        return f"{a + 200}{b // 10_000 + 200}{b % 10_000:04d}"
    place = area * 1_000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
    a, b = feistel(key, "phone-other", place, line, 360_000, 10_000)
    return (f"{a:06d}" if a < 200_000 else f"{200 + (a - 200_000) // 200}{(a - 200_000) % 200:03d}") + f"{b:04d}"


LONG_CODES = {"35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "83", "85", "87", "88", "89", "96", "97", "99"}


def phone(key, value):
    d = re.sub("[^0-9]", "", value)
    if value[0] == "(":
        return fill(value, american(key, d))
    if d[0] == "1":
        return fill(value, "1" + american(key, d[1:]))
    n = 1 if d[0] == "7" else 3 if d[:2] in LONG_CODES or d[0] == "2" and d[1] not in "07" else 2
    return fill(value, d[:n] + split_permuted(key, f"phone+{d[:n]}:", d[n:]))


def cards(key, value):
    """Groups of four from left to right; every four that pass are a card."""
    groups, seps, out, i = re.findall("[0-9]{4}", value), re.findall("[ -]", value) + [""], "", 0
    while i < len(groups):
        taken = 4 if i + 4 <= len(groups) and luhn("".join(groups[i : i + 4])) else 1
        part = "".join(g + s for g, s in zip(groups[i : i + taken], seps[i : i + taken]))
        out, i = out + (card(key, part) if taken == 4 else part), i + taken
    return out


def number97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def date(key, value):
    formats = ["%Y-%m-%d"] if "-" in value else [f"%d{value[2]}%m{value[2]}%Y", f"%m{value[2]}%d{value[2]}%Y"]
    for form in formats:
        try:
            n = (datetime.datetime.strptime(value, form).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            continue
        if not 0 <= n < 73_080:
            return value
        a, b = feistel(key, "date", n // 261, n % 261, 280, 261)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(days=a * 261 + b)).strftime(form)
    return value


def ip(key, value):
    o = list(map(int, value.split(".")))
    a, b = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def email(key, value):
    name, domain = value.split("@")
    half = (len(name) + 1) // 2
    parts = [name[:half], name[half:]]

    def shift(part, other, turn):
        out = ""
        for i, c in enumerate(part, 1):
            by = mac(key, "email", turn, other, len(part), i)
            first, size = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
            out += chr(first + (ord(c) - first + by) % size) if size else c
        return out

    for turn in range(8):
        k = turn % 2
        parts[k] = shift(parts[k], parts[1 - k], turn)
    return "".join(parts) + "@" + domain


# What personal values look like, stated apart from the library.
MAIL_LIKE = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,}"
DATE_LIKE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
IP_LIKE = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
CARD_LIKE = r"[0-9]{4}(?:[ -][0-9]{4}){3,11}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}"
SSN_LIKE = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IBAN_LIKE = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
PHONE_LIKE = (
    r"[+]1[ .-]?[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[+][2-9][0-9]{0,2}(?:[ .()-]{0,2}[0-9]){6,11}"
    r"|[(][0-9]{3}[)] ?[0-9]{3}[ .-][0-9]{4}"
)
LIKE = (
    rf"(?:(?<![A-Za-z0-9])(?:{MAIL_LIKE}|(?<![0-9][.])(?:{DATE_LIKE}|{IP_LIKE})(?![.][0-9])|{SSN_LIKE}|{CARD_LIKE}|{IBAN_LIKE})"
    rf"|{PHONE_LIKE})(?![A-Za-z0-9])"
)


def brute(key, text):
    """Values of all kinds but grouped IBANs, whose pseudonyms the tests below check."""

    def replace(m):
        v = m[0]
        if "@" in v:
            return email(key, v)
        if v[0] in "+(":
            return phone(key, v)
        if re.fullmatch(DATE_LIKE, v):
            return date(key, v)
        if v.count(".") == 3:
            return ip(key, v) if all(int(o) < 256 for o in v.split(".")) else v
        if re.fullmatch(CARD_LIKE, v):
            if re.fullmatch("[0-9]{4}(?:[ -][0-9]{4}){3,11}", v):
                return cards(key, v)
            return card(key, v) if luhn(re.sub("[^0-9]", "", v)) else v
        assert not re.fullmatch(IBAN_LIKE, v) or number97(v[4:] + v[:4]) != 1, "not built here"
        return v

    return re.sub(LIKE, replace, text)


def test_query_equals_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = QUERIES["op8_feistel_pseudonyms"](spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.text == brute(PII_KEY, texts[r.doc_id]), r.doc_id
    assert sum(r.n_card + r.n_phone + r.n_ip + r.n_email for r in got) > 50


def run(spark, *texts, key="k"):
    rows = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return [(r.text, r.pii) for r in P.pseudonymise(rows, key).orderBy("doc_id").collect()]


def test_values_stay_linked_and_valid(spark):
    texts = ["2024-02-29", "29.02.2024 x", "4041894974608795", "4041 8949 7460 8795 42.144.35.254", "123-45-6789", "DE89370400440532013000", "GB82WEST12345698765432"]
    (iso, _), (dots, _), (plain, _), (grouped, _), (ssn, _), (de, _), (gb, _) = run(spark, *texts)
    day = datetime.date.fromisoformat(iso)
    assert dots == day.strftime("%d.%m.%Y x") and iso != "2024-02-29"
    number, _, address = grouped.rpartition(" ")
    assert number.replace(" ", "") == plain and luhn(plain) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", number)
    assert re.fullmatch(r"(\d+\.){3}\d+", address)
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "123-45-6789"
    for iban, old in ((de, "DE89370400440532013000"), (gb, "GB82WEST12345698765432")):
        assert iban[:2] == old[:2] and len(iban) == len(old) and iban != old
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert run(spark, "2024-02-29", key="other")[0][0] != iso


def test_invalid_values_stay(spark):
    texts = ["2024-02-30", "999.1.1.1", "1.2.3.4.5", "4041894974608796", "000-12-3456", "DE88370400440532013000", "x12345678901234567890123"]
    assert [t for t, _ in run(spark, *texts)] == texts


SPELLINGS = [
    "+1 (017) 555-7713", "+1 (132) 555-1352", "+44 20 7946 0958", "+442079460958", "+7 495 123-45-67", "+353 1 234 5678",
    "(212) 555-0123", "+1 212-555-0123", "12/25/2020", "25/12/2020", "2020-12-25", "2024 4111 1111 1111 1111",
    "4111 1111 1111 1111 77", "4111-1111-1111-1111 2024 4041 8949 7460 8795", "a.b+c@d.e.org...then", "x@y.org.5 x@y.org",
]


def test_common_spellings(spark):
    got = [t for t, _ in run(spark, *SPELLINGS)]
    assert got == [brute("k", t) for t in SPELLINGS]
    assert all(a != b for a, b in zip(got, SPELLINGS))
    digits = [re.sub("[^0-9]", "", t) for t in got]
    # One number in several spellings keeps being one number.
    assert digits[2] == digits[3] and digits[7] == "1" + digits[6] and got[2].startswith("+44 ")
    assert got[8][3:5] + got[8][:2] == got[9][:2] + got[9][3:5]
    assert got[11].startswith("2024 ") and luhn(digits[11][4:])


def test_grouped_ibans(spark):
    plain = ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947", "FR1420041010050500013M02606"]
    grouped = [" ".join(p[i : i + 4] for i in range(0, len(p), 4)) for p in plain]
    got = [t for t, _ in run(spark, *plain, *[f"to {g} EUR" for g in grouped])]
    for old, new, spaced, shape in zip(plain, got, got[4:], grouped):
        assert new != old and len(new) == len(old) and new[:2] == old[:2] and number97(new[4:] + new[:4]) == 1
        assert spaced == "to " + " ".join(new[i : i + 4] for i in range(0, len(new), 4)) + " EUR"


def test_numbers_stay_different(spark):
    numbers = [f"+1{a:03d}{e:03d}0000" for a in (0, 1, 199, 200, 201, 999) for e in (0, 5, 199, 200, 700)]
    moved = [t for t, _ in run(spark, *numbers)]
    assert len(set(moved)) == len(numbers)
    valid = lambda n: n[2] >= "2" and n[5] >= "2"
    assert [valid(n) for n in numbers] == [valid(n) for n in moved]


def test_hostile_texts_take_linear_time(spark):
    texts = ["x@" + "a." * 100_000, "a." * 500_000, "a.b@" * 100_000, "4111 " * 100_000, "+44" * 100_000, "1.1." * 200_000]
    assert [t for t, _ in run(spark, *texts)] == texts


def test_days_are_permuted(spark):
    first = datetime.date(1900, 1, 1)
    days = [(first + datetime.timedelta(days=i)).isoformat() for i in range(0, 73_080, 37)]
    moved = [t for t, _ in run(spark, *days)]
    assert len(set(moved)) == len(days)
    assert all(datetime.date.fromisoformat(d) >= first for d in moved)


def test_odd_rows(spark):
    long = "word " * 50_000 + "+1 (988) 555-2485" + " word" * 50_000
    got = run(spark, None, "", long, "no values", "a@b")
    assert got[0][0] is None and got[1][0] == "" and got[3][0] == "no values" and got[4][0] == "a@b"
    assert len(got[2][0]) == len(long) and got[2][1].n_phone == 1 and got[2][0] == brute("k", long)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pseudonymise(empty, "k").count() == 0

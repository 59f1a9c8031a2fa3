"""Format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.base import let

ROUNDS = 8
# Kinds in the order in which they are tried.
KINDS = ("email", "date", "phone", "ip", "card", "iban", "ssn")
# Lengths of account numbers by country, from the public registry.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}
# Country calling codes of two digits; 1 and 7 have one, others three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 "
    "60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
)
# What a candidate of each kind looks like. Every pattern begins
# and ends with a letter or digit that no letter or digit may touch. All loops
# over groups are bounded by the longest valid value, so the time for a text
# follows its length, and no text needs a deep stack.
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,252}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
PHONE = (
    r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[2-9][0-9]{0,2}(?:[ .()-]{0,2}[0-9]){6,11}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
)
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
# Cards in groups of four may have other such groups beside them.
CARD_RUN = r"[0-9]{4}(?:[ -][0-9]{4}){3,11}"
CARD = rf"{CARD_RUN}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}|[0-9]{{13,19}}"
IBAN_GROUPS = "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(size - 4) // 4}}}"
    + (f" [A-Z0-9]{{{size % 4}}}" if size % 4 else "")
    for size, names in IBAN_COUNTRIES.items()
)
IBAN = f"{IBAN_GROUPS}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
BEFORE, AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
# Nor may a group of digits that goes on behind a dot.
ALONE_BEFORE, ALONE_AFTER = r"(?<![0-9]\.)", r"(?!\.[0-9])"
ANY = f"(?:{BEFORE}(?:{EMAIL}|{ALONE_BEFORE}(?:{DATE}|{IP}){ALONE_AFTER}|{SSN}|{CARD}|{IBAN})|{PHONE}){AFTER}"
# Dates move within this span: a whole number of rows and columns of days.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1900-01-01", 280, 261


def digest(key: str, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256 of some values."""
    told = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, rows: Column, columns: Column) -> Column:
    """Struct (left, right): a keyed permutation of rows x columns.

    Rounds add a digest of one part to the other, each modulo its own size, so
    the result has the same two ranges and different inputs stay different.
    """
    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))

    def step(pair: Column, turn: Column) -> Column:
        moved_left = F.pmod(pair["left"] + digest(key, tweak, turn, pair["right"]) % rows, rows)
        moved_right = F.pmod(pair["right"] + digest(key, tweak, turn, pair["left"]) % columns, columns)
        even = turn % 2 == 0
        return F.struct(
            F.when(even, moved_left).otherwise(pair["left"]).alias("left"),
            F.when(even, pair["right"]).otherwise(moved_right).alias("right"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def power_of_ten(count: Column) -> Column:
    return F.rpad(F.lit("1"), count + 1, F.lit("0")).cast("long")


def permuted_digits(key: str, tweak: str | Column, digits: Column) -> Column:
    """Digit string (2 to 36 long) to another of the same length."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    return let(
        F.floor(F.length(digits) / 2).cast("int"),
        lambda half: let(
            feistel(
                key,
                F.concat(tweak, F.length(digits).cast("string")),
                F.substring(digits, F.lit(1), half),
                F.substr(digits, half + 1),
                power_of_ten(half),
                power_of_ten(F.length(digits) - half),
            ),
            lambda pair: F.concat(
                F.lpad(pair["left"].cast("string"), half, F.lit("0")),
                F.lpad(pair["right"].cast("string"), F.length(digits) - half, F.lit("0")),
            ),
        ),
    )


def in_format(shape: Column, digits: Column, places: str = "[0-9]") -> Column:
    """Put the characters ``digits`` in the ``places`` of ``shape``."""
    pieces = F.split(shape, places)
    return F.array_join(
        F.transform(pieces, lambda piece, i: F.concat(piece, F.substring(digits, i + 1, F.lit(1)))), ""
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit at single weight."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return total + F.when(twice, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def is_card_number(value: Column) -> Column:
    return luhn_sum(digits_of(value)) % 10 == 0


def four_groups(run: Column, i: Column) -> Column:
    """Four groups of four digits of a run of groups, from group ``i`` on."""
    return F.substring(run, 5 * i + 1, F.lit(19))


def last_start(run: Column) -> Column:
    return F.floor((F.length(run) + 1) / 5).cast("int") - 4


def is_card(value: Column) -> Column:
    """One card number, or a run of groups of four with one in it."""
    starts = F.sequence(F.lit(0), F.greatest(last_start(value), F.lit(0)))
    in_run = F.exists(starts, lambda i: is_card_number(four_groups(value, i)))
    return value.rlike(f"^(?:{CARD})$") & F.when(value.rlike(f"^{CARD_RUN}$"), in_run).otherwise(is_card_number(value))


def cards_in_run(key: str, run: Column) -> Column:
    """The run with its cards replaced, from left to right; other groups stay."""
    kind = "struct<out: string, skip: int>"

    def step(state: Column, i: Column) -> Column:
        found = (i <= last_start(run)) & is_card_number(four_groups(run, i))
        group = F.concat(state["out"], F.substring(run, 5 * i + 1, F.lit(5)))
        card = F.concat(state["out"], card_pseudonym(key, four_groups(run, i)), F.substring(run, 5 * i + 20, F.lit(1)))
        return (
            F.when(state["skip"] > 0, F.struct(state["out"].alias("out"), (state["skip"] - 1).alias("skip")))
            .when(found, F.struct(card.alias("out"), F.lit(3).alias("skip")))
            .otherwise(F.struct(group.alias("out"), F.lit(0).alias("skip")))
        ).cast(kind)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), last_start(run) + 3), start, step, lambda s: s["out"])


def cards_pseudonym(key: str, value: Column) -> Column:
    return F.when(value.rlike(f"^{CARD_RUN}$"), cards_in_run(key, value)).otherwise(card_pseudonym(key, value))


def card_pseudonym(key: str, value: Column) -> Column:
    """All digits but the last are permuted; the last makes the sum right."""

    def build(digits: Column) -> Column:
        body = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return in_format(value, let(digits_of(value), build))


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text read as a number, letters from A as 10."""

    def add(rest: Column, i: Column) -> Column:
        char = F.substring(text, i, F.lit(1))
        digit = F.when(char.rlike("[0-9]"), char.cast("int")).otherwise(F.ascii(char) - 55)
        return (rest * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def without_blanks(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def is_iban(value: Column) -> Column:
    plain = without_blanks(value)
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return value.rlike(f"^(?:{IBAN})$") & (mod97(turned) == 1)


def iban_pseudonym(key: str, value: Column) -> Column:
    """Account digits and letters are permuted, the check digits made right;
    blanks between groups stay where they are."""
    return in_format(value, let(without_blanks(value), lambda plain: _iban(key, plain)), "[A-Z0-9]")


def _iban(key: str, value: Column) -> Column:
    country, account = F.substring(value, 1, 2), F.substr(value, F.lit(5))

    def build(moved: Column) -> Column:
        check = F.lit(98) - mod97(F.concat(moved, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), moved)

    return let(permuted_text(key, "iban", account), build)


def permuted_text(key: str, tweak: str, value: Column) -> Column:
    """Letters and digits to others of their own kind; the rest stays.

    A Feistel network over the two halves of the text: each round shifts the
    characters of one half within their alphabets by a digest of the other.
    """
    half = F.floor((F.length(value) + 1) / 2).cast("int")

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        def move(i: Column) -> Column:
            char = F.substring(part, i, F.lit(1))
            by = digest(key, F.lit(tweak), turn, other, F.length(part), i)

            def within(first: int, size: int) -> Column:
                return F.char(F.lit(first) + F.pmod(F.ascii(char) - first + by % size, F.lit(size)))

            return (
                F.when(char.rlike("[0-9]"), within(48, 10))
                .when(char.rlike("[a-z]"), within(97, 26))
                .when(char.rlike("[A-Z]"), within(65, 26))
                .otherwise(char)
            )

        moved = F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), move), "")
        return F.when(F.length(part) > 0, moved).otherwise("")

    def step(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, shifted(pair["left"], pair["right"], turn)).otherwise(pair["left"]).alias("left"),
            F.when(even, pair["right"]).otherwise(shifted(pair["right"], pair["left"], turn)).alias("right"),
        )

    start = F.struct(F.substring(value, F.lit(1), half).alias("left"), F.substr(value, half + 1).alias("right"))
    return let(
        F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda pair: F.concat(pair["left"], pair["right"])
    )


def email_pseudonym(key: str, value: Column) -> Column:
    """The part before the @ is permuted; the domain stays."""
    return F.concat(permuted_text(key, "email", F.substring_index(value, "@", 1)), F.lit("@"), F.substring_index(value, "@", -1))


def octet(value: Column, i: int) -> Column:
    return F.split(value, r"\.")[i].cast("int")


def is_ip(value: Column) -> Column:
    fits = F.lit(True)
    for i in range(4):
        fits = fits & (octet(value, i) <= 255)
    return value.rlike(f"^(?:{IP})$") & fits


def ip_pseudonym(key: str, value: Column) -> Column:
    """Another address; digits may be more or fewer, octets stay octets."""
    left, right = octet(value, 0) * 256 + octet(value, 1), octet(value, 2) * 256 + octet(value, 3)
    size = F.lit(65_536)
    return let(
        feistel(key, F.lit("ip"), left, right, size, size),
        lambda p: F.concat_ws(
            ".",
            *[x.cast("string") for side in ("left", "right") for x in (F.floor(p[side] / 256), p[side] % 256)],
        ),
    )


def phone_pseudonym(key: str, value: Column) -> Column:
    """The country code stays, the digits behind it are permuted.

    A number in brackets without a code is one of country 1. There, numbers
    whose area and exchange are valid (200 to 999) are permuted among
    themselves, and so are the others.
    """

    def international(digits: Column) -> Column:
        first_two = F.substring(digits, 1, 2)
        size = F.when(digits.startswith("7"), 1).when(first_two.isin(*TWO_DIGIT_CODES.split()), 2).otherwise(3)

        def build(n: Column) -> Column:
            code = F.substring(digits, F.lit(1), n)
            return F.concat(code, permuted_digits(key, F.concat(F.lit("phone+"), code, F.lit(":")), F.substr(digits, n + 1)))

        return let(size, build)

    def build(digits: Column) -> Column:
        american = F.when(value.startswith("+"), F.concat(F.lit("1"), american_number(key, F.substr(digits, F.lit(2)))))
        american = american.otherwise(american_number(key, digits))
        return F.when(value.startswith("+") & ~digits.startswith("1"), international(digits)).otherwise(american)

    return in_format(value, let(digits_of(value), build))


def american_number(key: str, digits: Column) -> Column:
    """Ten digits: area, exchange and line number."""

    def padded(number: Column, size: int) -> Column:
        return F.lpad(number.cast("string"), size, "0")

    def build(d: Column) -> Column:
        area, exchange = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 3).cast("long")
        line = F.substring(d, 7, 4).cast("long")
        valid = let(
            feistel(key, F.lit("phone"), area - 200, (exchange - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000)),
            lambda p: F.concat(
                padded(p["left"] + 200, 3), padded(F.floor(p["right"] / 10_000) + 200, 3), padded(p["right"] % 10_000, 4)
            ),
        )
        # The others in one row: low areas with any exchange, then the rest.
        place = F.when(area < 200, area * 1_000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        other = let(
            feistel(key, F.lit("phone-other"), place, line, F.lit(360_000), F.lit(10_000)),
            lambda p: F.concat(
                F.when(p["left"] < 200_000, padded(p["left"], 6)).otherwise(
                    F.concat(padded(F.floor((p["left"] - 200_000) / 200) + 200, 3), padded((p["left"] - 200_000) % 200, 3))
                ),
                padded(p["right"], 4),
            ),
        )
        return F.when((area >= 200) & (exchange >= 200), valid).otherwise(other)

    return let(digits, build)


def is_ssn(value: Column) -> Column:
    area = F.substring(value, 1, 3)
    return (
        value.rlike(f"^(?:{SSN})$")
        & ~area.isin("000", "666")
        & (area < "900")
        & (F.substring(value, 5, 2) != "00")
        & (F.substring(value, 8, 4) != "0000")
    )


def ssn_pseudonym(key: str, value: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99 and serials 0001-9999 stay so."""
    area = F.substring(value, 1, 3).cast("long")
    left = area - F.when(area > 666, 2).otherwise(1)
    right = (F.substring(value, 5, 2).cast("long") - 1) * 9_999 + F.substring(value, 8, 4).cast("long") - 1
    return let(
        feistel(key, F.lit("ssn"), left, right, F.lit(898), F.lit(99 * 9_999)),
        lambda p: F.concat_ws(
            "-",
            F.lpad((p["left"] + F.when(p["left"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(p["right"] / 9_999) + 1).cast("string"), 2, "0"),
            F.lpad((p["right"] % 9_999 + 1).cast("string"), 4, "0"),
        ),
    )


def date_in(value: Column, day: int, month: int) -> Column:
    """The date of a value with its year last, null if there is no such day."""
    iso = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, month, 2), F.substring(value, day, 2))
    return F.try_to_date(iso, "yyyy-MM-dd")


def is_month_first(value: Column) -> Column:
    return ~value.contains("-") & date_in(value, 1, 4).isNull()


def day_of(value: Column) -> Column:
    """Days since FIRST_DAY of a date in any of its formats, null outside.

    Where numbers are separated by dots or slashes the day comes first, or the
    month if only that is a date.
    """
    date = F.when(value.contains("-"), F.try_to_date(value, "yyyy-MM-dd")).otherwise(
        F.coalesce(date_in(value, 1, 4), date_in(value, 4, 1))
    )
    day = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    return F.when(value.rlike(f"^(?:{DATE})$") & day.between(0, DAY_ROWS * DAY_COLUMNS - 1), day)


def date_pseudonym(key: str, value: Column) -> Column:
    """Another day, the same in every format, in the format of the value."""

    def build(pair: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["left"] * DAY_COLUMNS + pair["right"]).cast("int"))
        mark = F.substring(value, 3, 1)
        dd, mm, yyyy = (F.date_format(day, part) for part in ("dd", "MM", "yyyy"))
        return (
            F.when(value.contains("-"), F.date_format(day, "yyyy-MM-dd"))
            .when(is_month_first(value), F.concat(mm, mark, dd, mark, yyyy))
            .otherwise(F.concat(dd, mark, mm, mark, yyyy))
        )

    def move(day: Column) -> Column:
        return let(
            feistel(
                key, F.lit("date"), F.floor(day / DAY_COLUMNS), day % DAY_COLUMNS, F.lit(DAY_ROWS), F.lit(DAY_COLUMNS)
            ),
            build,
        )

    return let(day_of(value), move)


def kind_of(value: Column) -> Column:
    """Kind of a candidate that passes its kind's test, else null."""
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.startswith("+") | value.startswith("("), F.lit("phone"))
        .when(day_of(value).isNotNull(), F.lit("date"))
        .when(is_ip(value), F.lit("ip"))
        .when(is_ssn(value), F.lit("ssn"))
        .when(is_card(value), F.lit("card"))
        .when(is_iban(value), F.lit("iban"))
    )


def pseudonym(key: str, kind: Column, value: Column) -> Column:
    made = {
        "email": email_pseudonym,
        "date": date_pseudonym,
        "phone": phone_pseudonym,
        "ip": ip_pseudonym,
        "card": cards_pseudonym,
        "iban": iban_pseudonym,
        "ssn": ssn_pseudonym,
    }
    out = value
    for name, build in made.items():
        out = F.when(kind == name, build(key, value)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, out: str = "pii") -> DataFrame:
    """Replace personal values in ``text``; add the struct ``out``.

    ``out`` holds n_<kind> for every kind. Equal values get equal pseudonyms in
    all documents, different values of a kind and format different ones; other
    candidates stay as they are, and so does all other text. Whoever has the
    key can undo it. Null and empty texts stay, with counts of zero. A column
    of ``docs`` named ``out`` is replaced.

    A projection over the scan: no shuffle and no Python. Candidates are cut
    out by one pattern, tested and permuted one by one, and put back.
    """
    if out in docs.columns:
        docs = docs.drop(out)
    text = F.coalesce("text", F.lit(""))
    # Most texts hold neither a digit nor an @, and are not taken apart.
    worth = text.rlike("[0-9@]")

    def tell(value: Column) -> Column:
        return F.struct(kind_of(value).alias("kind"), value.alias("value"))

    found = F.when(worth, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), tell))
    with_found = docs.withColumn(out, found)
    found = F.col(f"`{out}`")
    gaps = F.split(text, ANY, -1)
    rebuilt = F.array_join(
        F.transform(
            gaps,
            lambda gap, i: F.concat(
                gap, F.coalesce(let(F.get(found, i), lambda v: pseudonym(key, v["kind"], v["value"])), F.lit(""))
            ),
        ),
        "",
    )
    counts = [_count(found, kind).alias(f"n_{kind}") for kind in KINDS]
    columns = [
        (F.when(F.size(found) > 0, rebuilt).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`"))
        for c in docs.columns
    ]
    return with_found.select(*columns, F.struct(*counts).alias(out))


def _count(found: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(found, lambda v: v["kind"] == kind)), F.lit(0)).cast("long")

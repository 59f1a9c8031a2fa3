"""Contact and account entities found in page text and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, find_all, has, has_any, strip
from pagewright.functions.html import anchor_hrefs, raw_text
from pagewright.functions.urls import SPLIT, netloc_of

# Entity patterns and the markers of false positives.
# The address is group 1. Only the first word boundary of a run of its
# characters is tried, or the end of the match before, so that a long run is
# read once; a later boundary leads to the same @.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])(?:\b|(?:[.%+-]++|[A-Za-z0-9_]++)\b)|\G\b)"
    r"([A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b)"
)
EMAIL_SKIP = ["example.com", "test@", "noreply", "no-reply"]
PHONES = [
    r"\+?[0-9]{1,3}[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}",
    r"\([0-9]{3}\)\s?[0-9]{3}[-.\s]?[0-9]{4}",
    r"[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
]
PHONE_MIN_DIGITS = 10
USERNAMES = [
    r"@([A-Za-z0-9_]+)",
    r"github\.com/([A-Za-z0-9_-]+)",
    r"linkedin\.com/in/([A-Za-z0-9_-]+)",
]
USERNAME_LENGTHS = (2, 30)
PROFILE_LINKS = [
    ("github", r"github\.com/([A-Za-z0-9_-]+)"),
    ("twitter", r"(?:twitter|x)\.com/([A-Za-z0-9_]+)"),
    ("linkedin", r"linkedin\.com/in/([A-Za-z0-9_-]+)"),
    ("instagram", r"instagram\.com/([A-Za-z0-9_.]+)"),
]
# Nothing follows the labels, so their loop need not give any back; possessive,
# it runs without recursion on any number of labels.
DOMAIN = (
    r"(?:https?://)?(?:www\.)?"
    r"([a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*+)"
)
DOMAIN_SKIP = ["example", "localhost", "test"]


def emails_in(text: Column | str) -> Column:
    found = F.transform(find_all(as_col(text), EMAIL, 1), F.lower)
    return F.filter(found, lambda e: ~has_any(e, EMAIL_SKIP))


def mailto_emails(hrefs: Column) -> Column:
    mails = F.filter(hrefs, lambda h: F.startswith(h, F.lit("mailto:")))
    addresses = F.transform(
        mails, lambda h: F.lower(F.substring_index(F.replace(h, F.lit("mailto:")), "?", 1))
    )
    return F.filter(addresses, lambda a: has(a, "@"))


def phones_in(text: Column | str) -> Column:
    t = as_col(text)
    found = F.transform(F.concat(*[find_all(t, p) for p in PHONES]), strip)
    return F.filter(
        found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= PHONE_MIN_DIGITS
    )


def usernames_in(text: Column | str) -> Column:
    t = as_col(text)
    found = F.concat(*[find_all(t, p, 1) for p in USERNAMES])
    shortest, longest = USERNAME_LENGTHS
    return F.filter(found, lambda n: F.length(n).between(shortest, longest))


def profile_usernames(hrefs: Column) -> Column:
    def per_site(site: str, pattern: str) -> Column:
        names = F.transform(hrefs, lambda h: F.regexp_extract(h, pattern, 1))
        return F.transform(
            F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit(f"{site}:"), n)
        )

    return F.concat(*[per_site(s, p) for s, p in PROFILE_LINKS])


def domains_in(text: Column | str) -> Column:
    found = F.transform(find_all(as_col(text), DOMAIN, 1), F.lower)
    return F.filter(found, lambda d: has(d, ".") & ~has_any(d, DOMAIN_SKIP))


def linked_domains(hrefs: Column, url: Column | str) -> Column:
    own = netloc_of(url)
    hosts = F.transform(hrefs, lambda h: F.lower(F.regexp_extract(h, SPLIT, 2)))
    return F.filter(hosts, lambda d: (d != own) & has(d, "."))


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def extract_emails(html: Column | str) -> Column:
    h = as_col(html)
    return _set(F.concat(emails_in(raw_text(h)), mailto_emails(anchor_hrefs(h))))


def extract_phones(html: Column | str) -> Column:
    return _set(phones_in(raw_text(as_col(html))))


def extract_usernames(html: Column | str) -> Column:
    h = as_col(html)
    return _set(F.concat(usernames_in(raw_text(h)), profile_usernames(anchor_hrefs(h))))


def extract_domains(html: Column | str, url: Column | str) -> Column:
    h = as_col(html)
    return _set(F.concat(domains_in(raw_text(h)), linked_domains(anchor_hrefs(h), url)))


def entities_from(text: Column, hrefs: Column, url: Column) -> Column:
    """All four lists from a page text and its hrefs computed once."""
    return F.struct(
        _set(F.concat(emails_in(text), mailto_emails(hrefs))).alias("emails"),
        _set(phones_in(text)).alias("phones"),
        _set(F.concat(usernames_in(text), profile_usernames(hrefs))).alias("usernames"),
        _set(F.concat(domains_in(text), linked_domains(hrefs, url))).alias("domains"),
    )

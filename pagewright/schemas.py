"""Explicit schemas as DDL; nothing is inferred at read time."""

from __future__ import annotations

RAW_PAGES = "page_id BIGINT, url STRING, html STRING"

PAGES = (
    "url STRING, status_code INT, headers MAP<STRING,STRING>, content BINARY, html STRING, fetched_at TIMESTAMP"
)

TEXT_INFO = (
    "STRUCT<title: STRING, text: STRING, meta: MAP<STRING,STRING>, keywords: ARRAY<STRING>, "
    "language: STRING, word_count: INT, description: STRING, clean_text: STRING>"
)

STORED_RECORD = (
    f"url STRING, content STRUCT<text: {TEXT_INFO}>, "
    "metadata STRUCT<jsonld: ARRAY<STRING>, microdata: ARRAY<STRING>, "
    "opengraph: MAP<STRING,STRING>, twitter: MAP<STRING,STRING>>, timestamp STRING"
)

FRONTIER = "url STRING, depth INT, priority DOUBLE"
VISITED = "url STRING"
COUNTERS = "processed BIGINT, success BIGINT, errors BIGINT, saved_at TIMESTAMP"

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

LOG_LINE = (
    "timestamp STRING, level STRING, message STRING, error_type STRING, error_message STRING, "
    "context MAP<STRING,STRING>"
)

ARCHIVE_MEMBERS = "path string, kind string, ordinal int, member string, text string"

"""Message times: raw counters since 2001-01-01 UTC to Unix time and calendar parts.

All parts come from integer arithmetic on the Unix seconds, so they are UTC
whatever the session time zone is.
"""

from __future__ import annotations

# Unix time of 2001-01-01, and the border between seconds and nanoseconds.
EPOCH_2001 = 978307200
NANOSECOND_BORDER = 1_000_000_000_000
NANOSECONDS = 1_000_000_000


def unix_seconds(raw: str) -> str:
    """Raw date (nanoseconds, or seconds in old rows) to Unix seconds; times at or
    before 1970-01-01 count as unknown."""
    unix = f"(if({raw} > {NANOSECOND_BORDER}, {raw} div {NANOSECONDS}, {raw}) + {EPOCH_2001})"
    return f"CASE WHEN {unix} > 0 THEN {unix} END"


def utc_date(unix: str) -> str:
    """Day of a known Unix time."""
    return f"date_from_unix_date(CAST({unix} div 86400 AS INT))"


def utc_hour(timestamp: str) -> str:
    """Hour of the UTC day of a timestamp."""
    return f"CAST(pmod(unix_seconds({timestamp}), 86400) div 3600 AS INT)"

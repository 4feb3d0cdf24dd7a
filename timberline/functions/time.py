"""Timestamps as canonical text, milliseconds, and durations.

Everything goes through milliseconds since 1970 and zone-less timestamps, so no
result depends on the session's time zone.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPTED = r"^\d{4}-\d{2}-\d{2}([Tt ])\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$"
#: Seconds of each unit of a duration.
UNITS = {u: s for s, names in {1: "s sec secs second seconds", 60: "m min mins minute minutes", 3600: "h hour hours", 86400: "d day days", 604800: "w week weeks"}.items() for u in names.split()}


def iso(ms: Column) -> Column:
    """Milliseconds as YYYY-MM-DDTHH:MM:SS.mmmZ."""
    at = F.timestamp_add("MILLISECOND", ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T"), F.date_format(at, "HH:mm:ss.SSS"), F.lit("Z"))


def ntz_millis(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def parse_millis(text: Column) -> Column:
    """Milliseconds of RFC 3339 or zone-less text (read as UTC); the first comma
    counts as the dot of a fraction; null where it doesn't parse."""
    dotted = F.regexp_replace(text, r"^([^,]*),", "$1.")
    zoned = F.when(dotted.rlike(r"([Zz]|[+-]\d{2}:\d{2})$"), F.regexp_replace(dotted, "[Tt]", " ")).otherwise(F.concat(F.regexp_replace(dotted, "[Tt]", " "), F.lit("Z")))
    return F.when(dotted.rlike(ACCEPTED), F.unix_millis(F.try_to_timestamp(F.upper(zoned))))


def normalize(text: Column) -> Column:
    """Canonical text; what doesn't parse is kept as it is."""
    return F.coalesce(iso(parse_millis(text)), text)


def epoch_text(number: Column) -> Column:
    """Epoch seconds, or milliseconds from 1e12 on, as canonical text."""
    value = number.cast("double")
    return iso(F.when(F.abs(value) >= 1e12, value).otherwise(value * 1000).cast("long"))


def parse_duration(text: str) -> timedelta:
    """``15m``, ``24h``, ``7 days``; ValueError for anything else."""
    m = re.fullmatch(r"([0-9]+)\s*([A-Za-z]+)", text.strip())
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=int(m[1]) * UNITS[m[2].lower()])


def parse_instant(text: str) -> int:
    """Milliseconds of an RFC 3339 instant; the zone is required."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", text):
        raise ValueError(f"not an RFC 3339 time with a zone: {text!r}")
    at = datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)

"""The predicates of a log query, as one conjunction of pushable columns."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import time
from timberline.functions.text import all_of
from timberline.plans import fulltext


def status_range(text: str) -> tuple[int, int]:
    """``500`` or ``500-599``; ValueError if it is malformed or inverted."""
    low, _, high = text.partition("-")
    if not low.isdigit() or (high and not high.isdigit()) or ("-" in text and not high):
        raise ValueError(f"not a status range: {text!r}")
    pair = int(low), int(high or low)
    if pair[0] > pair[1]:
        raise ValueError(f"an inverted status range: {text!r}")
    return pair


@dataclass(frozen=True)
class LogQuery:
    """What is asked for; every field that is set must hold. ``now_ms`` is always
    given, so a query means the same on every run."""

    now_ms: int
    query: str | None = None
    level: str | None = None
    source: str | None = None
    log_id: str | None = None
    request_id: str | None = None
    user_id: str | None = None
    route: str | None = None
    method: str | None = None
    parse_format: str | None = None
    status: str | None = None
    slow_above: float | None = None
    last: str | None = None
    start: str | None = None
    end: str | None = None

    def echo(self) -> dict:
        """The applied filters, as they are reported; ``last`` hides start and end."""
        hidden = {"now_ms", *(("start", "end") if self.last else ())}
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in hidden and getattr(self, f.name) is not None}

    def condition(self) -> Column:
        parts = [F.col(n) == getattr(self, n) for n in ("level", "log_id", "request_id", "user_id", "route", "method") if getattr(self, n) is not None]
        parts += [F.col(n) == getattr(self, n).lower() for n in ("source", "parse_format") if getattr(self, n) is not None]
        if self.status is not None:
            parts.append(F.col("status_code").between(*status_range(self.status)))
        if self.slow_above is not None:
            parts.append(F.col("duration_ms") > self.slow_above)
        if self.last is not None:
            parts.append(F.col("timestamp_ms") >= self.now_ms - time.parse_duration(self.last).total_seconds() * 1000 // 1)
        else:
            if self.start is not None:
                parts.append(F.col("timestamp_ms") >= time.parse_instant(self.start))
            if self.end is not None:
                parts.append(F.col("timestamp_ms") <= time.parse_instant(self.end))
        if self.query is not None:
            parts.append(fulltext.condition(self.query))
        return all_of(parts)

    def apply(self, logs: DataFrame) -> DataFrame:
        return logs.where(self.condition())

"""Identity of a log row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.mask import short_hash


def log_id(timestamp: Column, level: Column, source: Column, message: Column, request_id: Column, position: Column | None = None) -> Column:
    """Hash of the row's content. Rows without a time of their own pass a null
    ``timestamp`` and their position instead, so equal lines stay apart."""
    text = lambda c: F.coalesce(c, F.lit(""))
    joined = F.concat(text(timestamp), F.lit("|"), level, F.lit("|"), source, F.lit("|"), text(message), F.lit("|"), text(request_id))
    if position is not None:
        joined = F.when(timestamp.isNull(), F.concat(joined, F.lit("|"), position)).otherwise(joined)
    return short_hash(joined)

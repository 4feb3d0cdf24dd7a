"""Merging rows by identity, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import time


def latest(rows: DataFrame) -> DataFrame:
    """One row per log_id, the last in the order of ingest."""
    names = rows.columns
    last = rows.groupBy("log_id").agg(F.max_by(F.struct(*names), F.struct("ingest_seq", "ingest_pos")).alias("r"))
    return last.select(*(f"r.{n}" for n in names))


def merge(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """``existing`` with ``rows`` put in the place of their equals."""
    new = latest(rows)
    return existing.join(new.select("log_id"), "log_id", "left_anti").unionByName(new)


def split_by_age(logs: DataFrame, retention_days: int, now_ms: int) -> DataFrame:
    """Rows with ``expired``: their time, as text, is at or before the cutoff."""
    cutoff = time.iso(F.lit(now_ms - retention_days * 86_400_000).cast("long"))
    return logs.withColumn("expired", F.col("timestamp") <= cutoff)

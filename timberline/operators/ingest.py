"""Raw lines to log rows: coalesce, parse, redact, normalise, identify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import ids, time
from timberline.functions.redact import redact, redact_json
from timberline.operators.coalesce import coalesce_blocks
from timberline.operators.lines import parse_blocks
from timberline.operators.structured import NAMES
from timberline.schema import LOG_SCHEMA


def rows_from_blocks(blocks: DataFrame, now_ms: Column, source: Column, redacted: bool = True) -> DataFrame:
    """``blocks``: path, byte, text. One row per event with content, by LOG_SCHEMA.

    Rows without a time of their own get ``now`` and an identity salted with their
    position. Redaction comes before the identity; ids and codes aren't redacted.
    """
    year = F.year(F.timestamp_millis(now_ms))
    got = parse_blocks(blocks, "text", year).where("parsed.ok")
    got = got.select("path", "byte", source.alias("default_source"), F.col("parsed.format").alias("parse_format"), *(F.col(f"parsed.{n}").alias(n) for n in NAMES))
    if redacted:
        for name in ("message", "error_name", "error_message", "route"):
            got = got.withColumn(name, redact(F.col(name)))
        got = got.withColumn("attributes", redact_json(F.col("attributes")))
    got = got.withColumn("timestamp", time.normalize(F.col("timestamp")))
    own = F.when(F.col("timestamp") != "", F.col("timestamp"))
    position = F.concat("path", F.lit(":"), F.col("byte").cast("string"))
    got = got.withColumns({
        "level": F.lower(F.coalesce("level", F.lit("info"))),
        "source": F.lower(F.coalesce("source", "default_source")),
        "message": F.coalesce("message", F.lit("")),
        "ingest_pos": position,
        "ingest_seq": F.col("byte"),
    })
    got = got.withColumn("log_id", ids.log_id(own, F.col("level"), F.col("source"), F.col("message"), F.col("request_id"), F.col("ingest_pos")))
    got = got.withColumn("timestamp", F.coalesce(own, time.iso(now_ms)))
    ms = time.parse_millis(F.col("timestamp"))
    got = got.withColumn("timestamp_ms", F.when(ms >= 0, ms))
    return got.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields))


def ingest(lines: DataFrame, now_ms: Column, source: Column | None = None, redacted: bool = True) -> DataFrame:
    """``lines``: path, byte, line. The source is the stem of the path by default."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1) if source is None else source
    return rows_from_blocks(coalesce_blocks(lines), now_ms, stem, redacted)

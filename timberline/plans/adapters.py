"""Log rows and log lines made from the fixture tables, for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import ids, time

#: The instant that the queries take for the present.
NOW_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """``events`` as log rows; ``hourly`` cuts times to the hour, which makes ties."""
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    ts = F.date_trunc("hour", "ts").cast("timestamp_ntz") if hourly else F.col("ts")
    failed = kind == "error"
    message = (
        F.when(failed & (n % 3 == 0), F.concat(F.lit("Connection timeout to db-"), text(n % 9), F.lit(".internal after "), text(n % 2000), F.lit("ms")))
        .when(failed & (n % 3 == 1), F.concat(F.lit("Login of 'u"), text(F.col("user_id")), F.lit("' refused from 10.0."), text(n % 4), F.lit("."), text(n % 250)))
        .when(failed, F.concat(F.lit("Worker "), text(n % 12), F.lit(" died: no such job")))
        .otherwise(F.concat(F.lit("GET /api/v1/"), kind, F.lit("/"), text(n), F.lit(" in "), text(n % 900), F.lit("ms")))
    )
    rows = e.select(
        time.ntz_millis(ts).alias("timestamp_ms"),
        F.when(failed, "error").when(kind == "signup", "warn").otherwise("info").alias("level"),
        F.concat(F.lit("svc-"), text(n % 5)).alias("source"),
        message.alias("message"),
        F.concat(F.lit("req-"), text(F.floor(n / 3))).alias("request_id"),
        F.when(F.col("user_id") % 7 != 0, text(F.col("user_id"))).alias("user_id"),
        F.when(n % 11 != 0, F.concat(F.lit("/"), kind)).alias("route"),
        F.when(n % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(failed, 500 + n % 4).when(kind == "signup", 404).otherwise(200).cast("int").alias("status_code"),
        F.col("value").alias("duration_ms"),
        F.when(failed & (n % 3 == 0), "DatabaseError").when(failed & (n % 3 == 1), "AuthError").alias("error_name"),
        F.when(failed & (n % 3 != 2), message).alias("error_message"),
        F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("long").alias("line_number"),
        F.col("props").alias("attributes"),
        F.when(n % 4 == 0, "json").when(n % 4 == 1, "logfmt").when(n % 4 == 2, "raw").alias("parse_format"),
        F.concat(F.lit("events:"), text(n)).alias("ingest_pos"),
        n.alias("ingest_seq"),
    )
    rows = rows.withColumn("timestamp", time.iso(F.col("timestamp_ms")))
    return rows.withColumn("log_id", ids.log_id(*(F.col(c) for c in ("timestamp", "level", "source", "message", "request_id"))))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw line for each event, in one of eight formats: event_id, kind, line."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    ms = F.date_format("ts", "SSS")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    month = F.element_at(F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), F.month("ts"))
    user, kind = text(F.col("user_id")), F.col("event_type")
    lines = [
        join('{"ts":"', day, "T", clock, ".", ms, 'Z","severity":"WARN","msg":"', kind, ' done","userId":"u', user, '","statusCode":', text(200 + n % 5), ',"duration":', text(n % 700), ',"extra_key":{"b":1,"a":[1,2]},"line":', text(n % 90), "}"),
        join("time=", day, "T", clock, "Z level=error msg=\"", kind, " failed \\\"hard\\\"\" service=s", text(n % 3), " uid=", user),
        join("10.0.0.", text(n % 250), " - - [", F.date_format("ts", "dd"), "/", month, "/", F.date_format("ts", "yyyy"), ":", clock, ' +0000] "GET /', kind, "/", text(n), ' HTTP/1.1" ', text(F.when(n % 3 == 0, 500).when(n % 3 == 1, 404).otherwise(200)), " ", text(n % 5000)),
        join(day, " ", clock, ",", ms, " - app.", kind, " - CRITICAL - job ", text(n), " lost"),
        join(day, " ", clock, ",", ms, " FATAL [main-", text(n % 4), "] com.acme.", kind, " - stopped ", text(n)),
        join(F.date_format("ts", "yyyy/MM/dd"), " ", clock, " PANIC ", kind, ".go:", text(n % 99), ": boom ", text(n)),
        join("<", text(n % 192), ">1 ", day, "T", clock, ".", ms, "Z host", text(n % 3), " ", kind, " ", text(n % 999), " ID7 - user ", user),
        join("\u001b[31m  something ", F.when(n % 3 == 0, "failed").when(n % 3 == 1, "deprecated").otherwise("went on"), " for ", user, "\u001b[0m"),
    ]
    line = lines[7]
    for k in range(6, -1, -1):
        line = F.when(n % 8 == k, lines[k]).otherwise(line)
    return e.select("event_id", (n % 8).alias("kind"), line.alias("line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document with their byte offsets; each third line is
    indented and each seventh is blank, so that events have several lines."""
    d = table(spark, sf_dir, "documents")
    parts = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    line = F.when(F.col("k") % 7 == 6, "").when(F.col("k") % 3 != 0, F.concat(F.lit("  "), "raw")).otherwise(F.col("raw"))
    return parts.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("k").cast("long").alias("byte"), line.alias("line"))


LOGS_SQL = """
raw_logs AS (
  SELECT event_id AS n, {ts} AS ts, user_id AS u, event_type AS kind, value, props FROM events),
said AS (
  SELECT *, CASE
    WHEN kind = 'error' AND n % 3 = 0 THEN 'Connection timeout to db-' || (n % 9) || '.internal after ' || (n % 2000) || 'ms'
    WHEN kind = 'error' AND n % 3 = 1 THEN 'Login of ''u' || u || ''' refused from 10.0.' || (n % 4) || '.' || (n % 250)
    WHEN kind = 'error' THEN 'Worker ' || (n % 12) || ' died: no such job'
    ELSE 'GET /api/v1/' || kind || '/' || n || ' in ' || (n % 900) || 'ms' END AS message,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
    CASE kind WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
    'svc-' || (n % 5) AS source, 'req-' || (n // 3) AS request_id
  FROM raw_logs),
logs AS (
  SELECT substr(sha256(timestamp || '|' || level || '|' || source || '|' || message || '|' || request_id), 1, 16) AS log_id,
    timestamp, CAST(epoch_us(ts) // 1000 AS BIGINT) AS timestamp_ms, level, source, message, request_id,
    CASE WHEN u % 7 <> 0 THEN CAST(u AS VARCHAR) END AS user_id,
    CASE WHEN n % 11 <> 0 THEN '/' || kind END AS route,
    CASE WHEN n % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    CAST(CASE kind WHEN 'error' THEN 500 + n % 4 WHEN 'signup' THEN 404 ELSE 200 END AS INTEGER) AS status_code,
    value AS duration_ms,
    CASE WHEN kind = 'error' AND n % 3 = 0 THEN 'DatabaseError' WHEN kind = 'error' AND n % 3 = 1 THEN 'AuthError' END AS error_name,
    CASE WHEN kind = 'error' AND n % 3 <> 2 THEN message END AS error_message,
    props AS attributes,
    CASE n % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' WHEN 2 THEN 'raw' END AS parse_format,
    n AS ingest_seq
  FROM said)"""


def logs_sql(hourly: bool = False) -> str:
    """The same rows for the expected results, as ``WITH`` parts ending in logs."""
    return LOGS_SQL.format(ts="date_trunc('hour', ts)" if hourly else "ts")

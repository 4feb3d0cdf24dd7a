"""The log row: one fixed core and a JSON text for everything else."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 6

LOG_SCHEMA = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("level", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("error_name", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("attributes", T.StringType()),
    T.StructField("parse_format", T.StringType()),
    T.StructField("ingest_pos", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
])

#: Input keys of each field, the first present one of a fitting kind wins.
ALIASES = {
    "timestamp": ["timestamp", "time", "ts", "@timestamp", "datetime"],
    "level": ["level", "severity", "lvl"],
    "message": ["message", "msg"],
    "source": ["source"],
    "request_id": ["request_id", "requestId", "reqId", "correlation_id", "correlationId"],
    "user_id": ["user_id", "userId", "uid"],
    "route": ["route", "path", "url", "endpoint"],
    "method": ["method"],
    "status_code": ["status_code", "statusCode", "status"],
    "duration_ms": ["duration_ms", "durationMs", "duration", "response_time_ms"],
    "source_file": ["source_file", "sourceFile"],
    "line_number": ["line_number", "lineNumber", "line"],
}
#: Names of the formats, in the order in which a line is tried.
FORMATS = ["json", "logfmt", "apache-combined", "python-logging", "go-logrus", "log4j", "syslog", "raw"]
#: Other names under which a format may be asked for.
FORMAT_ALIASES = {
    "json": "json", "jsonl": "json", "logfmt": "logfmt", "apache": "apache-combined", "apache-combined": "apache-combined",
    "nginx": "apache-combined", "python": "python-logging", "python-logging": "python-logging", "go": "go-logrus",
    "logrus": "go-logrus", "go-logrus": "go-logrus", "log4j": "log4j", "log4j2": "log4j", "syslog": "syslog", "raw": "raw",
}

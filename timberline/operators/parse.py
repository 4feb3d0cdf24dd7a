"""Format detection and parsing of log lines, as projections.

Each parser gives a struct of the common fields, or null where the line isn't of
its format. Ingest, which tries all formats on every line, uses ``lines.parse_blocks``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import text, time
from timberline.operators.structured import structured

_T = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}"
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_APACHE = r'^([\d.:a-fA-F]+)\s+-\s+-\s+\[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})\]\s+"([A-Z]+)\s+([^"]+)\s+HTTP/\d+\.\d+"\s+(\d{3})\s+(\d+)'
# Line shapes that tell a format, in the order of detection ...
LOGFMT_PAIR = r'[^\s="]+=(?:"(?:[^"\\]|\\.)*(?:"|$)|[^\s"]*)'
LOGFMT_KEYS = ["level", "lvl", "msg", "message", "time", "ts", "timestamp", "severity"]
DETECT = {
    "apache-combined": r'^\S+\s+\S+\s+\S+\s+\[.+?\]\s+"\S+\s+\S+\s+HTTP/\d\.\d"\s+\d+\s+\d+',
    "python-logging": rf"^{_T}\s+[-|]\s+(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL)|^{_T}\s+[-|]\s+[\w.:]+\s+[-|]\s+(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\s+[-|]",
    "go-logrus": r"^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+(DEBUG|INFO|WARN|ERROR|FATAL|PANIC)",
    "log4j": rf"^{_T}\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)",
    "syslog": rf"^<\d{{1,3}}>\d\s+\S+\s+\S+\s+\S+|^(?:<\d{{1,3}}>)?({_MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\S+\s+[\w\-./]+(\[\d+\])?:",
}
# ... and the shapes that take a line apart.
APACHE_FULL = _APACHE + r'(?:\s+"([^"]*)"\s+"([^"]*)")?'
PYTHON_NAME_FIRST = rf"^({_T})\s+[-|]\s+([\w.:]+)\s+[-|]\s+((?i:DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL))\s+[-|]\s*(.*)"
PYTHON_LEVEL_FIRST = rf"^({_T})\s+[-|]\s+(\w+)\s+[-|]\s+([\w.:]+)?\s+[-|]\s*(.*)"
PYTHON_SIMPLE = rf"^({_T})\s+[-|]\s+(\w+)\s+[-|]\s*(.*)"
LOGRUS = r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\w+)\s+(?:([\w.]+):\d+:\s+)?(.*)"
LOG4J_THREAD = rf"^({_T})\s+(\w+)\s+\[\s*([\w\-]+)\s*\]\s+([\w.]+)\s+-\s+(.*)"
LOG4J_SIMPLE = rf"^({_T})\s+(\w+)\s+([\w.]+)\s+-\s+(.*)"
LOG4J_MINIMAL = rf"^({_T})\s+(\w+)\s+-\s+(.*)"
RFC5424 = r"^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|\[[^\]]*\])\s*(.*)$"
RFC3164 = rf"^(?:<(\d{{1,3}})>)?({_MONTHS})\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})\s+(\S+)\s+([\w\-./]+)(?:\[(\d+)\])?:\s*(.*)$"

FIELDS = {
    "timestamp": "string", "level": "string", "message": "string", "source": "string", "request_id": "string", "user_id": "string",
    "route": "string", "method": "string", "status_code": "int", "duration_ms": "double", "error_name": "string", "error_message": "string",
    "source_file": "string", "line_number": "bigint", "attributes": "string",
}


def record(**fields: Column) -> Column:
    return F.struct(*(F.expr(f"CAST(NULL AS {kind})").alias(n) if n not in fields else fields[n].cast(kind).alias(n) for n, kind in FIELDS.items()))


def group(line: Column, pattern: str, k: int) -> Column:
    """A group, null where it is empty; only for lines that match."""
    got = F.regexp_extract(line, f"(?s){pattern}", k)
    return F.when(got != "", got)


def _text(line: Column, pattern: str, k: int) -> Column:
    return text.trim_all(F.regexp_extract(line, f"(?s){pattern}", k))


# ------------------------------------------------------------------ detection
def is_logfmt(line: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(line, F.lit(f"({LOGFMT_PAIR})"), F.lit(1)), lambda p: F.substring_index(p, "=", 1))
    return line.rlike(rf"^\s*{LOGFMT_PAIR}(\s+{LOGFMT_PAIR})+\s*$") & F.arrays_overlap(keys, F.array(*map(F.lit, LOGFMT_KEYS)))


def detect(line: Column) -> Column:
    """The format of a single line; ``raw`` where no shape fits."""
    out = F.when(line.startswith("{"), "json").when(is_logfmt(line), "logfmt")
    for name, pattern in DETECT.items():
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("raw")


def detect_sample(lines: Column) -> Column:
    """The format of an array of lines: JSON if more than 70 % begin with a brace,
    else the format of the first line that has another."""
    braces = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("{")))
    others = F.filter(F.transform(lines, lambda x: detect(x)), lambda f: ~f.isin("raw", "json"))
    return F.when(braces > 0.7 * F.size(lines), "json").when(F.size(others) > 0, F.element_at(others, 1)).otherwise("raw")


# -------------------------------------------------------------- structured rows
def _structured_row(got: Column) -> Column:
    fields = {n: got[n] for n in FIELDS}
    fields["timestamp"] = time.normalize(got["timestamp"])
    return F.when(got["ok"], record(**fields))


def parse_json(line: Column) -> Column:
    """A JSON object, by the alias lists."""
    return _structured_row(structured(line, F.lit("json")))


def parse_logfmt(line: Column) -> Column:
    return _structured_row(structured(line, F.lit("logfmt")))


# ------------------------------------------------------------------- text rows
def parse_apache(line: Column) -> Column:
    g = lambda k: group(line, APACHE_FULL, k)
    status = g(5).cast("int")
    at = F.regexp_replace(g(2), r"^(\d{2})/([A-Za-z]{3})/(\d{4}):(\S+)\s.*$", "$3-$2-$1T$4.000Z")
    for number, month in enumerate(_MONTHS.split("|"), 1):
        at = F.replace(at, F.lit(f"-{month}-"), F.lit(f"-{number:02d}-"))
    agent = F.when(F.regexp_extract(line, APACHE_FULL, 8) != "", g(8)).otherwise("-")
    return F.when(
        line.rlike(APACHE_FULL),
        record(
            timestamp=at, level=F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info"),
            message=F.concat(g(3), F.lit(" "), g(4), F.lit(" - "), agent), method=g(3), route=g(4), status_code=status,
        ),
    )


def _level(name: Column, **other: str) -> Column:
    upper = F.upper(name)
    out = F.lower(name)
    for k, v in other.items():
        out = F.when(upper == k, v).otherwise(out)
    return out


def _dotted(at: Column) -> Column:
    """``date time,millis`` as canonical text."""
    return F.regexp_replace(at, r"^(\S+)\s+(\d{2}:\d{2}:\d{2})[,.](\d{3})$", "$1T$2.$3Z")


def parse_python(line: Column) -> Column:
    level = lambda c: _level(c, WARNING="warn", CRITICAL="error", FATAL="error")
    first, second, third = PYTHON_NAME_FIRST, PYTHON_LEVEL_FIRST, PYTHON_SIMPLE
    return (
        F.when(line.rlike(first), record(timestamp=_dotted(group(line, first, 1)), level=level(group(line, first, 3)), source_file=group(line, first, 2), message=_text(line, first, 4)))
        .when(line.rlike(second), record(timestamp=_dotted(group(line, second, 1)), level=level(group(line, second, 2)), source_file=group(line, second, 3), message=_text(line, second, 4)))
        .when(line.rlike(third), record(timestamp=_dotted(group(line, third, 1)), level=level(group(line, third, 2)), message=_text(line, third, 3)))
    )


def parse_log4j(line: Column) -> Column:
    """Times are canonical, so rows answer to time filters."""
    level = lambda c: _level(c, TRACE="debug", FATAL="error")
    thread, simple, least = LOG4J_THREAD, LOG4J_SIMPLE, LOG4J_MINIMAL
    return (
        F.when(line.rlike(thread), record(timestamp=_dotted(group(line, thread, 1)), level=level(group(line, thread, 2)), source_file=group(line, thread, 4), message=_text(line, thread, 5)))
        .when(line.rlike(simple), record(timestamp=_dotted(group(line, simple, 1)), level=level(group(line, simple, 2)), source_file=group(line, simple, 3), message=_text(line, simple, 4)))
        .when(line.rlike(least), record(timestamp=_dotted(group(line, least, 1)), level=level(group(line, least, 2)), message=_text(line, least, 3)))
    )


def parse_logrus(line: Column) -> Column:
    at = F.regexp_replace(group(line, LOGRUS, 1), r"^(\d{4})/(\d{2})/(\d{2})\s+(\S+)$", "$1-$2-$3T$4.000Z")
    level = _level(group(line, LOGRUS, 2), WARNING="warn", FATAL="error", PANIC="error")
    return F.when(line.rlike(LOGRUS), record(timestamp=at, level=level, source_file=group(line, LOGRUS, 3), message=_text(line, LOGRUS, 4)))


def parse_syslog(line: Column, year: Column) -> Column:
    severity = lambda pri: F.when(pri % 8 <= 3, "error").when(pri % 8 == 4, "warn").when(pri % 8 <= 6, "info").otherwise("debug")
    new, old = RFC5424, RFC3164
    at = group(line, new, 3)
    month = F.lit(0)
    for number, name in enumerate(_MONTHS.split("|"), 1):
        month = F.when(group(line, old, 2) == name, number).otherwise(month)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    old_at = F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(group(line, old, 3)), F.lit("T"), group(line, old, 4), F.lit(".000Z"))
    pri = group(line, old, 1).cast("int")
    new_pri = group(line, new, 1).cast("int")
    return (
        F.when(line.rlike(new) & (new_pri <= 255), record(timestamp=F.when(at != "-", time.normalize(at)), level=severity(new_pri), source_file=group(line, new, 5), message=F.regexp_extract(line, new, 8)))
        .when(line.rlike(old), record(timestamp=old_at, level=F.when(pri.isNotNull(), severity(pri)), source_file=group(line, old, 6), message=F.regexp_extract(line, old, 8)))
    )


def parse_raw(line: Column) -> Column:
    """Text without colour codes; null where it has no letter or digit."""
    clean = text.trim_all(text.strip_ansi(line))
    return F.when(clean.rlike(r"[\p{L}\p{N}]"), record(message=clean, level=text.sniff_level(clean)))

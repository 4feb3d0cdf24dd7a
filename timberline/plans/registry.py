"""Named queries over the fixture tables, and the SQL that expects the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import mask, redact, stack, text, time
from timberline.operators import coalesce, ingest, parse, upsert
from timberline.plans import aggregate, alert, search
from timberline.plans.adapters import NOW_MS, document_lines, event_lines, event_logs, logs_sql, table
from timberline.plans.filters import LogQuery
from timberline.streaming.watch import error_rate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def ask(**fields) -> LogQuery:
    return LogQuery(now_ms=NOW_MS, **fields)


def over(select: str, hourly: bool = False, more: str = "") -> str:
    return f"WITH {logs_sql(hourly)}{more} {select}"


def _mask_sql(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return column


_TEMPLATE = _mask_sql("@@", mask.TEMPLATE_STEPS)
_KEYED = ", keyed AS (SELECT *, coalesce(error_name, 'Unknown') AS name, " + _TEMPLATE.replace("@@", "CASE WHEN error_name IS NOT NULL OR error_message IS NOT NULL THEN coalesce(error_message, '') ELSE message END") + " AS template, CASE WHEN error_name IS NOT NULL OR error_message IS NOT NULL THEN coalesce(error_message, '') ELSE message END AS said FROM logs WHERE level = 'error'), grouped AS (SELECT *, substr(sha256(name || '|' || template), 1, 16) AS fingerprint FROM keyed)"
_GROUPS = "SELECT fingerprint, count(*) AS count, count(DISTINCT user_id) AS affected_users, min(timestamp) AS first_seen, max(timestamp) AS last_seen, arg_min(name, timestamp || log_id) AS name, arg_min(said, timestamp || log_id) AS message, arg_min(template, timestamp || log_id) AS template, array_to_string(list(log_id ORDER BY timestamp, log_id)[1:3], ',') AS samples FROM grouped"


def _flat(groups: DataFrame) -> DataFrame:
    return groups.withColumn("samples", F.array_join("samples", ","))


# ------------------------------------------------------------------- errors
@query("errors_top_groups", over(f"{_GROUPS} WHERE timestamp_ms >= {NOW_MS} - 10 * 86400000 GROUP BY fingerprint ORDER BY count DESC, last_seen DESC, strlen(arg_min(template, timestamp || log_id)) DESC, fingerprint LIMIT 10", more=_KEYED))
def errors_top_groups(spark, sf_dir):
    return _flat(aggregate.error_groups(ask(last="10d").apply(event_logs(spark, sf_dir))))


@query("errors_all_groups", over(f"{_GROUPS} GROUP BY fingerprint", more=_KEYED))
def errors_all_groups(spark, sf_dir):
    return _flat(aggregate.error_groups(event_logs(spark, sf_dir), limit=None))


@query("errors_fallback_message", over(f"{_GROUPS} WHERE error_name IS NULL GROUP BY fingerprint", more=_KEYED))
def errors_fallback_message(spark, sf_dir):
    return _flat(aggregate.error_groups(event_logs(spark, sf_dir).where("error_name is null"), limit=None))


@query("errors_affected_users", over("SELECT fingerprint, count(DISTINCT user_id) AS affected_users FROM grouped GROUP BY fingerprint", more=_KEYED))
def errors_affected_users(spark, sf_dir):
    rows = aggregate.keyed_errors(event_logs(spark, sf_dir))
    return rows.groupBy("fingerprint").agg(F.countDistinct("user_id").alias("affected_users"))


#: An instant within the events, for what looks at the last minutes.
MIDWAY_MS = 1_705_752_000_000  # 2024-01-20T12:00:00Z


@query("alert_recent", over(f"{_GROUPS} WHERE timestamp_ms >= {MIDWAY_MS} - 900000 GROUP BY fingerprint ORDER BY count DESC, last_seen DESC, strlen(arg_min(template, timestamp || log_id)) DESC, fingerprint LIMIT 3", more=_KEYED))
def alert_recent(spark, sf_dir):
    return _flat(alert.recent_groups(event_logs(spark, sf_dir), MIDWAY_MS))


@query("error_rate_windows", over("SELECT CAST(timestamp_ms - timestamp_ms % 300000 AS BIGINT) AS start_ms, fingerprint, count(*) AS count FROM grouped GROUP BY 1, 2", more=_KEYED))
def error_rate_windows(spark, sf_dir):
    return error_rate(event_logs(spark, sf_dir)).select(F.unix_millis("window.start").alias("start_ms"), "fingerprint", "count")


# -------------------------------------------------------------------- stats
for _name, _column in {"level": "level", "route": "route", "user": "user_id", "format": "parse_format"}.items():
    _default = aggregate.NULL_NAMES[_column]
    query(f"stats_by_{_name}", over(f"SELECT coalesce({_column}, '{_default}') AS value, count(*) AS count FROM logs GROUP BY 1"))(lambda spark, sf_dir, c=_column: aggregate.stats(event_logs(spark, sf_dir), c))


@query("stats_multi_dim", over(" UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, '{d}') AS value, count(*) AS count FROM logs GROUP BY 2" for c, d in aggregate.NULL_NAMES.items())))
def stats_multi_dim(spark, sf_dir):
    return aggregate.stats_of(event_logs(spark, sf_dir), list(aggregate.NULL_NAMES))


@query("stats_errors_only", over(f"SELECT coalesce(route, 'unknown') AS value, count(*) AS count FROM logs WHERE level = 'error' AND timestamp_ms >= {NOW_MS} - 7 * 86400000 GROUP BY 1"))
def stats_errors_only(spark, sf_dir):
    return aggregate.stats(ask(level="error", last="7d").apply(event_logs(spark, sf_dir)), "route")


@query("index_stats", over("SELECT 'total' AS measure, CAST(count(*) AS VARCHAR) AS value FROM logs UNION ALL SELECT 'oldest', min(timestamp) FROM logs UNION ALL SELECT 'newest', max(timestamp) FROM logs UNION ALL SELECT 'level:' || level, CAST(count(*) AS VARCHAR) FROM logs GROUP BY level UNION ALL SELECT 'source:' || source, CAST(count(*) AS VARCHAR) FROM logs GROUP BY source"))
def index_stats(spark, sf_dir):
    return aggregate.index_stats(event_logs(spark, sf_dir))


# ------------------------------------------------------------------- search
_PAGE = "log_id", "timestamp", "level", "source", "message", "user_id", "status_code"
_ROWS = f"SELECT {', '.join(_PAGE)} FROM logs WHERE "
_NEWEST = " ORDER BY timestamp DESC, log_id LIMIT "


def _search(name: str, where: str, limit: int = 100, offset: int = 0, **fields) -> None:
    sql = over(_ROWS + where + _NEWEST + f"{limit} OFFSET {offset}")
    query(name, sql)(lambda spark, sf_dir: search.search(event_logs(spark, sf_dir), ask(**fields), limit, offset).select(*_PAGE))


_TOKENS = "(' ' || array_to_string(list_filter(regexp_split_to_array(lower(message || ' ' || coalesce(route, '') || ' ' || coalesce(user_id, '') || ' ' || request_id || ' ' || coalesce(error_message, '') || ' k ' || regexp_extract(attributes, '(-?[0-9]+)', 1)), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ')"
_search("search_level", "level = 'error'", level="error")
_search("search_time_range", "timestamp_ms BETWEEN 1704844800000 AND 1704931200000", start="2024-01-10T00:00:00Z", end="2024-01-11T00:00:00Z")
_search("search_last", f"timestamp_ms >= {NOW_MS} - 2 * 86400000", last="48h")
_search("search_status_range", "status_code BETWEEN 501 AND 502", status="501-502")
_search("search_slow_above", "duration_ms > 80", slow_above=80.0)
_search("search_pagination", "source = 'svc-3'", limit=25, offset=50, source="SVC-3")
_search("search_format", "parse_format = 'logfmt'", parse_format="logfmt")
_search("search_fulltext_or", f"{_TOKENS} LIKE '% timeout %' OR {_TOKENS} LIKE '% refused %'", query="timeout refused")
_search("search_fulltext_and_not", f"{_TOKENS} LIKE '% timeout %' AND {_TOKENS} LIKE '% internal %' AND NOT {_TOKENS} LIKE '% db 3 %'", query="timeout AND internal NOT db-3")
_search("search_phrase", f"{_TOKENS} LIKE '% no such job %' AND {_TOKENS} LIKE '% worker 8 %'", query='+"no such job" +"worker 8"')
_search("search_field_term", "level = 'warn' AND status_code BETWEEN 400 AND 499", query="level:warn AND status_code:[400 TO 499]")


_search("search_nested", f"({_TOKENS} LIKE '% timeout %' OR {_TOKENS} LIKE '% refused %') AND level = 'error' AND NOT {_TOKENS} LIKE '% db 3 %'", query='(timeout OR refused) AND level:error -"db 3"')
_search("search_nested_not", f"{_TOKENS} LIKE '% job %' OR ({_TOKENS} LIKE '% timeout %' AND NOT ({_TOKENS} LIKE '% db 1 %' OR {_TOKENS} LIKE '% db 2 %'))", limit=500, query="job OR (timeout NOT (db-1 OR db-2))")


@query("page_time_range", over(f"SELECT min(timestamp) AS oldest, max(timestamp) AS newest FROM (SELECT timestamp FROM logs WHERE level = 'warn'{_NEWEST} 40 OFFSET 10)"))
def page_time_range(spark, sf_dir):
    page = search.search(event_logs(spark, sf_dir), ask(level="warn"), 40, 10)
    return page.agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


_GET = f"SELECT {', '.join(_PAGE)} FROM logs WHERE "


@query("get_by_log_id", over(_GET + "log_id = (SELECT min(log_id) FROM logs)"))
def get_by_log_id(spark, sf_dir):
    logs = event_logs(spark, sf_dir)
    least = logs.agg(F.min("log_id")).scalar()  # a subquery; nothing runs before the result is asked for
    return search.get(logs, ask(log_id=least)).select(*_PAGE)


@query("get_by_request", over(_GET + "request_id = 'req-77'"))
def get_by_request(spark, sf_dir):
    return search.get(event_logs(spark, sf_dir), ask(request_id="req-77")).select(*_PAGE)


@query("get_by_user", over(_GET + "user_id = '5'"))
def get_by_user(spark, sf_dir):
    return search.get(event_logs(spark, sf_dir), ask(user_id="5")).select(*_PAGE)


@query("context_neighbors", over("""SELECT target, side, CAST(position AS INTEGER) AS position, log_id, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY timestamp DESC, log_id DESC) AS position FROM (SELECT t.log_id AS target, 'before' AS side, l.log_id, l.timestamp FROM targets t JOIN logs l ON l.timestamp <= t.timestamp AND l.log_id <> t.log_id)
  UNION ALL
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY timestamp, log_id) FROM (SELECT t.log_id AS target, 'after' AS side, l.log_id, l.timestamp FROM targets t JOIN logs l ON l.timestamp >= t.timestamp AND l.log_id <> t.log_id)
) WHERE position <= 3""", hourly=True, more=", targets AS (SELECT log_id, timestamp FROM logs WHERE level = 'error' ORDER BY timestamp DESC, log_id LIMIT 20)"))
def context_neighbors(spark, sf_dir):
    logs = event_logs(spark, sf_dir, hourly=True)
    page = search.search(logs, ask(level="error"), 20)
    return search.context(logs, page, 3)


# -------------------------------------------------------- retention and merge
@query("retention_split", over(f"SELECT timestamp <= '2024-01-16T00:00:00.000Z' AS expired, count(*) AS count, min(timestamp) AS oldest, max(timestamp) AS newest FROM logs GROUP BY 1"))
def retention_split(spark, sf_dir):
    aged = upsert.split_by_age(event_logs(spark, sf_dir), 15, NOW_MS)
    return aged.groupBy("expired").agg(F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


@query("dedup_upsert", over("SELECT log_id, timestamp, CAST(CASE WHEN ingest_seq % 3 = 0 THEN ingest_seq + 1000000 ELSE ingest_seq END AS BIGINT) AS ingest_seq, CASE WHEN ingest_seq % 3 = 0 THEN 'again' ELSE route END AS route FROM logs"))
def dedup_upsert(spark, sf_dir):
    logs = event_logs(spark, sf_dir)
    again = logs.where("ingest_seq % 3 = 0").withColumns({"route": F.lit("again"), "ingest_seq": F.col("ingest_seq") + 1_000_000})
    return upsert.merge(logs, again).select("log_id", "timestamp", "ingest_seq", "route")


# ------------------------------------------------------------ scalar functions
def _over_texts(name: str, make, sql: str) -> None:
    parts = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")]

    def run(spark, sf_dir):
        out = None
        for t, key, column in parts:
            rows = table(spark, sf_dir, t)
            one = rows.select(F.lit(t).alias("origin"), F.col(key).alias("id"), F.sha2(make(F.col(column)).cast("binary"), 256).alias("digest"), F.length(make(F.col(column))).alias("n"))
            out = one if out is None else out.unionByName(one)
        return out

    query(name, " UNION ALL ".join(f"SELECT '{t}' AS origin, {key} AS id, sha256({sql.replace("@@", column)}) AS digest, CAST(length({sql.replace("@@", column)}) AS INTEGER) AS n FROM {t}" for t, key, column in parts))(run)


_over_texts("mask_template", mask.template, _TEMPLATE)
_over_texts("mask_extended", mask.extended, _mask_sql("@@", mask.EXTENDED_STEPS))
_REDACT = _mask_sql("@@", [(p, to.replace("$1", r"\1").replace("$2", r"\2")) for p, to in redact.STEPS])
_over_texts("redact_pii", redact.redact, _REDACT)
_WORDS = ["all went well", "TypeError: x", "DEPRECATED call", "debug only", "ENOENT here", "cannot open", "ESLint passed", "warning: soon", "trace off", "it panicked", "✗ broken", "a failing test"]


@query("sniff_level", "SELECT doc_id, CASE doc_id % 12 WHEN 1 THEN 'error' WHEN 2 THEN 'warn' WHEN 3 THEN 'debug' WHEN 4 THEN 'error' WHEN 5 THEN 'error' WHEN 7 THEN 'warn' WHEN 8 THEN 'debug' WHEN 9 THEN 'error' WHEN 10 THEN 'error' WHEN 11 THEN 'error' END AS level FROM documents")
def sniff_level(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.sniff_level(F.concat(words, F.lit("\n"), F.lower("text"))).alias("level"))


@query("strip_ansi", "SELECT doc_id, text AS clean FROM documents")
def strip_ansi(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;31m"), F.regexp_replace("text", " ", "\x1b[0m \x1b]8;;http://x\x07"), F.lit("\x1b]0;t\x1b\\"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_ansi(coloured).alias("clean"))


@query("timestamp_normalize", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS comma, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS zoned, strftime(ts, '%Y-%m-%d') AS kept, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def timestamp_normalize(spark, sf_dir):
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    comma = F.concat(day, F.lit(" "), clock, F.lit(","), F.date_format("ts", "SSS"))
    return table(spark, sf_dir, "events").select("event_id", time.normalize(comma).alias("comma"), time.normalize(F.concat(day, F.lit("T"), clock, F.lit("+02:00"))).alias("zoned"), time.normalize(day).alias("kept"), time.parse_millis(comma).alias("ms"))


@query("epoch_text", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS millis FROM events")
def epoch_text(spark, sf_dir):
    ms = time.ntz_millis(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", time.epoch_text(F.floor(ms / 1000)).alias("seconds"), time.epoch_text(ms).alias("millis"))


@query("log_id", over("SELECT ingest_seq, log_id FROM logs"))
def log_id(spark, sf_dir):
    return event_logs(spark, sf_dir).select("ingest_seq", "log_id")


@query("full_text_tokens", over(f"SELECT ingest_seq, trim({_TOKENS}) AS tokens FROM logs"))
def full_text_tokens(spark, sf_dir):
    return event_logs(spark, sf_dir).select("ingest_seq", F.array_join(text.tokens(text.full_text()), " ").alias("tokens"))


@query("stack_frames", "SELECT doc_id, n, function, file, line, \"column\" FROM (SELECT doc_id, 0 AS n, 'run' AS function, 'src/a' || doc_id || '.ts' AS file, doc_id % 50 AS line, 7 AS \"column\" FROM documents UNION ALL SELECT doc_id, 1, 'main', '/app/x.py', doc_id % 9, NULL FROM documents UNION ALL SELECT doc_id, 2, NULL, 'src/lib.rs', 3, doc_id % 8 FROM documents)")
def stack_frames(spark, sf_dir):
    n = F.col("doc_id")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    trace = say("TypeError: no\n    at run (src/a", n, ".ts:", n % 50, ":7)\n  File \"/app/x.py\", line ", n % 9, ", in main\n   nothing here\n   at src/lib.rs:3:", n % 8)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(stack.frames(trace)).alias("n", "f"))
    return rows.select("doc_id", "n", "f.function", "f.file", "f.line", "f.column")


# --------------------------------------------------------- lines and formats
@query("detect_format", "SELECT event_id, ['json','logfmt','apache-combined','python-logging','log4j','go-logrus','syslog','raw'][event_id % 8 + 1] AS format FROM events")
def detect_format(spark, sf_dir):
    return event_lines(spark, sf_dir).select("event_id", parse.detect(F.col("line")).alias("format"))


_MS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
_S = "strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z')"
_COMMON = "timestamp", "level", "message", "source_file", "user_id", "route", "method", "status_code", "duration_ms", "line_number", "attributes"


def _parsed(name: str, kind: int, parser, **expected: str) -> None:
    kinds = {"status_code": "INTEGER", "duration_ms": "DOUBLE", "line_number": "BIGINT"}
    columns = ", ".join(f"CAST({expected.get(c, 'NULL')} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in _COMMON)

    def run(spark, sf_dir):
        rows = event_lines(spark, sf_dir).where(F.col("kind") == kind)
        return rows.select("event_id", parser(F.col("line")).alias("r")).select("event_id", *(F.col(f"r.{c}").alias(c) for c in _COMMON))

    query(name, f"SELECT event_id, {columns} FROM events WHERE event_id % 8 = {kind}")(run)


_parsed("parse_json", 0, parse.parse_json, timestamp=_MS, level="'WARN'", message="event_type || ' done'", user_id="'u' || user_id", status_code="200 + event_id % 5", duration_ms="event_id % 700", line_number="event_id % 90", attributes="'{\"extra_key\":{\"a\":[1,2],\"b\":1}}'")
_parsed("parse_logfmt", 1, parse.parse_logfmt, timestamp=_S, level="'error'", message="event_type || ' failed \"hard\"'", user_id="user_id", attributes="'{\"service\":\"s' || (event_id % 3) || '\"}'")
_parsed("parse_apache", 2, parse.parse_apache, timestamp=_S, level="CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END", message="'GET /' || event_type || '/' || event_id || ' - -'", route="'/' || event_type || '/' || event_id", method="'GET'", status_code="CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END")
_parsed("parse_python", 3, parse.parse_python, timestamp=_MS, level="'error'", message="'job ' || event_id || ' lost'", source_file="'app.' || event_type")
_parsed("parse_log4j", 4, parse.parse_log4j, timestamp=_MS, level="'error'", message="'stopped ' || event_id", source_file="'com.acme.' || event_type")
_parsed("parse_logrus", 5, parse.parse_logrus, timestamp=_S, level="'error'", message="'boom ' || event_id", source_file="event_type || '.go'")
_parsed("parse_syslog", 6, lambda line: parse.parse_syslog(line, F.lit(2024)), timestamp=_MS, level="CASE WHEN event_id % 192 % 8 <= 3 THEN 'error' WHEN event_id % 192 % 8 = 4 THEN 'warn' WHEN event_id % 192 % 8 <= 6 THEN 'info' ELSE 'debug' END", message="'user ' || user_id", source_file="event_type")
_parsed("parse_raw", 7, parse.parse_raw, level="CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' END", message="'something ' || CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'deprecated' ELSE 'went on' END || ' for ' || user_id")


@query("ingest_lines", "SELECT parse_format, count(*) AS count FROM (SELECT ['json','logfmt','apache-combined','python-logging','log4j','go-logrus','syslog','raw'][event_id % 8 + 1] AS parse_format FROM events) GROUP BY 1")
def ingest_lines(spark, sf_dir):
    lines = event_lines(spark, sf_dir).select(F.concat(F.lit("f"), (F.col("event_id") % 16).cast("string")).alias("path"), F.col("event_id").alias("byte"), F.regexp_replace("line", "^(\x1b\\[31m)  ", "$1").alias("line"))
    return ingest.ingest(lines, F.lit(NOW_MS).cast("long")).groupBy("parse_format").agg(F.count(F.lit(1)).alias("count"))


@query("coalesce_blocks", r"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
shaped AS (SELECT 'doc-' || doc_id AS path, k, CASE WHEN k % 7 = 6 THEN '' WHEN k % 3 <> 0 THEN '  ' || l ELSE l END AS line FROM raw),
marked AS (SELECT *, regexp_matches(line, '^\s*$') AS blank, lag(regexp_matches(line, '^\s*$'), 1, true) OVER (PARTITION BY path ORDER BY k) AS after_blank,
  (line[1] = ' ' AND NOT regexp_matches(trim(line), '(?i)^(error|warning|info|hint)\s*[•:\-]')) OR starts_with(line, 'Caused by') AS cont FROM shaped),
runs AS (SELECT *, sum(CASE WHEN NOT blank AND (after_blank OR NOT cont) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY k) AS run FROM marked),
kept AS (SELECT path, run, k, line, strlen(line) AS size, row_number() OVER (PARTITION BY path, run ORDER BY k) AS i FROM runs WHERE NOT blank),
fold AS (
  SELECT path, run, i, k AS byte, line AS text, 1 AS n, size FROM kept WHERE i = 1
  UNION ALL
  SELECT f.path, f.run, s.i,
    CASE WHEN f.n >= 64 OR f.size + s.size > 8192 THEN s.k ELSE f.byte END,
    CASE WHEN f.n >= 64 OR f.size + s.size > 8192 THEN s.line ELSE f.text || chr(10) || s.line END,
    CASE WHEN f.n >= 64 OR f.size + s.size > 8192 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 64 OR f.size + s.size > 8192 THEN s.size ELSE f.size + 1 + s.size END
  FROM fold f JOIN kept s ON s.path = f.path AND s.run = f.run AND s.i = f.i + 1)
SELECT path, CAST(byte AS BIGINT) AS byte, arg_max(text, i) AS text FROM fold GROUP BY path, byte
""")
def coalesce_blocks(spark, sf_dir):
    return coalesce.coalesce_blocks(document_lines(spark, sf_dir))


@query("trace_conversation", "SELECT conv_id, turn, role, before, after FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)")
def trace_conversation(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(order).alias("before"), F.lead("role").over(order).alias("after"))


@query("stream_tail_upsert", over("SELECT parse_format, level, count(*) AS count FROM (SELECT 'json' AS parse_format, level FROM logs) GROUP BY 1, 2"))
def stream_tail_upsert(spark, sf_dir):
    """Write the events as a file of JSON lines, twice over, and stream it into a
    table: the second half replaces the first."""
    import uuid

    from timberline.sources.discover import shared_folder
    from timberline.streaming.table import LogTable
    from timberline.streaming.watch import watch

    root = f"{shared_folder(spark)}/tail-{uuid.uuid4().hex[:12]}"
    logs = event_logs(spark, sf_dir)
    names = ["timestamp", "level", "source", "message", "request_id", "user_id"]
    lines = logs.select(F.to_json(F.struct(*names)).alias("value"))
    lines.unionByName(lines).write.text(f"{root}/lines")
    log = LogTable(spark, f"{root}/table")
    watch(spark, f"{root}/lines/*.txt", log, f"{root}/checkpoint", NOW_MS, once=True).awaitTermination()
    return log.read().groupBy("parse_format", "level").agg(F.count(F.lit(1)).alias("count"))

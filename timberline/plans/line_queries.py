"""Further registered queries: lines and files through ingest, and whole commands.

The lines are made from the fixture tables, so SQL over these states every row that
ingest must give for them.
"""

from __future__ import annotations

import io
import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline import cli
from timberline.operators import drain, ingest, learn, parse
from timberline.plans import aggregate, alert, fulltext, search
from timberline.plans.adapters import NOW_MS, event_lines, event_logs, table
from timberline.plans.registry import _COMMON, _NEWEST, _PAGE, _ROWS, _TOKENS, ORACLE_SQL, QUERIES, ask, over, query
from timberline.project import Project
from timberline.sources.discover import shared_folder

_MS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
_S = "strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z')"
_NOW = "'2024-01-31T00:00:00.000Z'"
_KINDS = {"status_code": "INTEGER", "duration_ms": "DOUBLE", "line_number": "BIGINT"}
_ROW = "parse_format", *_COMMON


def _expected(kinds: dict[str, dict[str, str]]) -> str:
    """One SELECT for each condition, with NULL for the fields that aren't stated."""
    cells = lambda of: ", ".join(f"CAST({of.get(c, 'NULL')} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c in _ROW)
    return " UNION ALL ".join(f"SELECT event_id, {cells(of)} FROM events WHERE {where}" for where, of in kinds.items())


def _ingested(lines: DataFrame, redacted: bool = False) -> DataFrame:
    return ingest.ingest(lines, F.lit(NOW_MS).cast("long"), redacted=redacted)


# ------------------------------------------------------------- rows of ingest
_LEVELS = "CASE WHEN event_id % 192 % 8 <= 3 THEN 'error' WHEN event_id % 192 % 8 = 4 THEN 'warn' WHEN event_id % 192 % 8 <= 6 THEN 'info' ELSE 'debug' END"
_HTTP = "CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END"


@query("ingest_rows", _expected({
    "event_id % 8 = 0": dict(parse_format="'json'", timestamp=_MS, level="'warn'", message="event_type || ' done'", user_id="'u' || user_id", status_code="200 + event_id % 5", duration_ms="event_id % 700", line_number="event_id % 90", attributes="'{\"extra_key\":{\"a\":[1,2],\"b\":1}}'"),
    "event_id % 8 = 1": dict(parse_format="'logfmt'", timestamp=_S, level="'error'", message="event_type || ' failed \"hard\"'", user_id="user_id", attributes="'{\"service\":\"s' || (event_id % 3) || '\"}'"),
    "event_id % 8 = 2": dict(parse_format="'apache-combined'", timestamp=_S, level=_HTTP, message="'GET /' || event_type || '/' || event_id || ' - -'", route="'/' || event_type || '/' || event_id", method="'GET'", status_code="CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END"),
    "event_id % 8 = 3": dict(parse_format="'python-logging'", timestamp=_MS, level="'error'", message="'job ' || event_id || ' lost'", source_file="'app.' || event_type"),
    "event_id % 8 = 4": dict(parse_format="'log4j'", timestamp=_MS, level="'error'", message="'stopped ' || event_id", source_file="'com.acme.' || event_type"),
    "event_id % 8 = 5": dict(parse_format="'go-logrus'", timestamp=_S, level="'error'", message="'boom ' || event_id", source_file="event_type || '.go'"),
    "event_id % 8 = 6": dict(parse_format="'syslog'", timestamp=_MS, level=_LEVELS, message="'user ' || user_id", source_file="event_type"),
    "event_id % 8 = 7": dict(parse_format="'raw'", timestamp=_NOW, level="CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END", message="'something ' || CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'deprecated' ELSE 'went on' END || ' for ' || user_id"),
}))
def ingest_rows(spark, sf_dir):
    """Every format through ingest, field by field; each line is a file of its own."""
    lines = event_lines(spark, sf_dir).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("byte"), "line")
    return _ingested(lines).select(F.col("ingest_seq").alias("event_id"), *_ROW)


def more_lines(spark, sf_dir: str) -> DataFrame:
    """path, byte, line: events of one to four lines in the rarer shapes, a sixteenth
    of the events in each file; a blank line ends every ninth event."""
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    day, clock, ms = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.date_format("ts", "SSS")
    month, date = F.element_at(F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), F.month("ts")), F.date_format("ts", "dd")
    blank, tail = F.lit(""), F.lit("  and on")
    events = [
        F.array(join("<", text(n % 192), ">", month, " ", F.dayofmonth("ts").cast("string"), " ", clock, " host", text(n % 3), " ", kind, "[", text(n % 999), "]: user ", text(F.col("user_id")))),
        F.array(join(month, " ", date, " ", clock, " host cron.d/", kind, ": ran ", text(n)), tail),
        F.array(join("10.1.0.", text(n % 250), " - - [", date, "/", month, "/", F.date_format("ts", "yyyy"), ":", clock, ' +0000] "POST /', kind, '?a=b HTTP/2.0" ', text(200 + n % 3 * 150), ' 17 "http://from/', text(n), '" "Agent/', text(n % 7), ' (x; y)"')),
        F.array(join(day, " ", clock, ".", ms, " - WARNING - app.", kind, ":", text(n % 50), " - slow ", text(n)), F.lit('  File "/app/x.py", line 3, in main'), F.lit("Caused by: no"), tail),
        F.array(join(day, " ", clock, ",", ms, " | INFO | ready ", text(n))),
        F.array(join(day, " ", clock, ",", ms, " TRACE com.acme.", kind, " - entering ", text(n)), F.lit("\tat com.acme.Main"), blank),
        F.array(join(day, " ", clock, ",", ms, " WARN - least ", text(n))),
        F.array(join('{"a":NaN,"message":"', kind, '"}')),
        F.array(join('{"timestamp":"', day, "T", clock, "Z", '","level":"ERROR","error":{"name":"DbError","message":"lost ', text(n), '","stack":"DbError: lost\\n    at run (src/db.ts:', text(n % 60), ':9)"},"reqId":"r', text(n), '","url":"/', kind, '","count":', text(n % 4), "}")),
        F.array(join('{"ts":"soon ', text(n), '","msg":"no time of day","lvl":"info"}'), tail),
        F.array(join("  error: labelled ", text(n)), tail, blank),
        F.array(join("plain text ", kind, " ", text(n)), F.lit("    more of it"), F.lit("  can't go on")),
        F.array(join('lvl=warn msg="open quote ', text(n))),
    ]
    made = events[-1]
    for k in range(len(events) - 2, -1, -1):
        made = F.when(n % len(events) == k, events[k]).otherwise(made)
    made = F.when(n % 9 == 0, F.concat(made, F.array(F.lit(" ")))).otherwise(made)
    return e.select(F.concat(F.lit("g"), text(n % 16)).alias("path"), n.alias("n"), F.posexplode(made).alias("k", "line")).select("path", (F.col("n") * 10 + F.col("k")).alias("byte"), "line")


_ON = "chr(10) || '  and on'"


@query("ingest_more_rows", _expected({
    "event_id % 13 = 0": dict(parse_format="'syslog'", timestamp=_S, level=_LEVELS, message="'user ' || user_id", source_file="event_type"),
    "event_id % 13 = 1": dict(parse_format="'syslog'", timestamp=_S, level="'info'", message=f"'ran ' || event_id || {_ON}", source_file="'cron.d/' || event_type"),
    "event_id % 13 = 2": dict(parse_format="'apache-combined'", timestamp=_S, level="CASE event_id % 3 WHEN 2 THEN 'error' ELSE 'info' END", message="'POST /' || event_type || '?a=b - Agent/' || (event_id % 7) || ' (x; y)'", route="'/' || event_type || '?a=b'", method="'POST'", status_code="200 + event_id % 3 * 150"),
    "event_id % 13 = 3": dict(parse_format="'python-logging'", timestamp=_MS, level="'warn'", message=f"'slow ' || event_id || chr(10) || '  File \"/app/x.py\", line 3, in main' || chr(10) || 'Caused by: no' || {_ON}", source_file="'app.' || event_type || ':' || (event_id % 50)"),
    "event_id % 13 = 4": dict(parse_format="'python-logging'", timestamp=_MS, level="'info'", message="'ready ' || event_id"),
    "event_id % 13 = 5": dict(parse_format="'log4j'", timestamp=_MS, level="'debug'", message="'entering ' || event_id || chr(10) || chr(9) || 'at com.acme.Main'", source_file="'com.acme.' || event_type"),
    "event_id % 13 = 6": dict(parse_format="'log4j'", timestamp=_MS, level="'warn'", message="'least ' || event_id"),
    "event_id % 13 = 7": dict(parse_format="'raw'", timestamp=_NOW, level="CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END", message="'{\"a\":NaN,\"message\":\"' || event_type || '\"}'"),
    "event_id % 13 = 8": dict(parse_format="'json'", timestamp=_S, level="'error'", message="''", route="'/' || event_type", source_file="'src/db.ts'", line_number="event_id % 60", attributes="'{\"count\":' || (event_id % 4) || '}'"),
    "event_id % 13 = 9": dict(parse_format="'json'", timestamp="'soon ' || event_id", level="'info'", message=f"'no time of day' || {_ON}"),
    "event_id % 13 = 10": dict(parse_format="'raw'", timestamp=_NOW, level="'error'", message=f"'error: labelled ' || event_id || {_ON}"),
    "event_id % 13 = 11": dict(parse_format="'raw'", timestamp=_NOW, level="'error'", message="'plain text ' || event_type || ' ' || event_id || chr(10) || '    more of it' || chr(10) || '  can''t go on'"),
    "event_id % 13 = 12": dict(parse_format="'logfmt'", timestamp=_NOW, level="'warn'", message="'open quote ' || event_id"),
}))
def ingest_more_rows(spark, sf_dir):
    """Rarer shapes, events of several lines, diagnostics, and what isn't JSON."""
    return _ingested(more_lines(spark, sf_dir)).select(F.floor(F.col("ingest_seq") / 10).alias("event_id"), *_ROW)


@query("ingest_error_fields", "SELECT event_id, 'DbError' AS error_name, 'lost ' || event_id AS error_message, 'r' || event_id AS request_id, 'g' || (event_id % 16) AS source FROM events WHERE event_id % 13 = 8")
def ingest_error_fields(spark, sf_dir):
    return _ingested(more_lines(spark, sf_dir)).where("error_name is not null").select(F.floor(F.col("ingest_seq") / 10).alias("event_id"), "error_name", "error_message", "request_id", "source")


@query("null_times", f"""WITH rows AS (SELECT event_id, CASE WHEN event_id % 13 = 9 THEN NULL WHEN event_id % 13 IN (7, 10, 11, 12) THEN {NOW_MS} WHEN event_id % 13 IN (3, 4, 5, 6) THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 * 1000 END AS ms FROM events)
SELECT 'rows' AS asked, count(*) AS count FROM rows UNION ALL SELECT 'no time', count(*) FROM rows WHERE ms IS NULL UNION ALL SELECT 'last', count(*) FROM rows WHERE ms >= {NOW_MS} - 20 * 86400000
UNION ALL SELECT 'until', count(*) FROM rows WHERE ms <= 1705752000000""")
def null_times(spark, sf_dir):
    """Rows whose time can't be read answer to no time filter, not even an open one."""
    rows = _ingested(more_lines(spark, sf_dir))
    asked = {"rows": ask(), "last": ask(last="20d"), "until": ask(end="2024-01-20T12:00:00Z")}
    counts = [F.count_if(q.condition()).alias(name) for name, q in asked.items()] + [F.count_if(F.col("timestamp_ms").isNull()).alias("no time")]
    one = rows.agg(*counts)
    return one.select(F.explode(F.create_map(*(x for c in one.columns for x in (F.lit(c), F.col(f"`{c}`"))))).alias("asked", "count"))


_MAIL, _NAME = "'mail u' || user_id || '@example.com now'", "'u' || user_id || '@example.com'"


@query("redaction_scope", f"SELECT event_id, 'mail [EMAIL REDACTED] now' AS message, 'lost [EMAIL REDACTED]' AS error_message, '/u/[EMAIL REDACTED]' AS route, '{{\"to\":[\"[EMAIL REDACTED]\",5]}}' AS attributes, {_NAME} AS user_id, {_NAME} AS request_id, CAST(200 AS INTEGER) AS status_code FROM events")
def redaction_scope(spark, sf_dir):
    """Texts, routes and attributes are redacted before the identity; ids aren't."""
    e = table(spark, sf_dir, "events")
    mail = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))
    said = F.struct(F.concat(F.lit("mail "), mail, F.lit(" now")).alias("message"), F.concat(F.lit("lost "), mail).alias("error"), F.concat(F.lit("/u/"), mail).alias("route"), mail.alias("user_id"), mail.alias("request_id"), F.lit(200).alias("status"), F.struct(F.lit(1)).alias("unused"), F.array(mail, F.lit("5")).alias("to"))
    line = F.regexp_replace(F.to_json(said.dropFields("unused")), '"5"', "5")
    rows = _ingested(e.select(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("byte"), line.alias("line")), redacted=True)
    return rows.select(F.col("ingest_seq").alias("event_id"), "message", "error_message", "route", "attributes", "user_id", "request_id", "status_code")


@query("detect_sample", """WITH lines AS (SELECT event_id // 40 AS sample, event_id, CASE
  WHEN event_id // 40 % 5 = 1 OR event_id // 40 % 5 = 3 AND event_id % 4 <> 3 OR event_id // 40 % 5 = 4 AND event_id % 10 < 6 THEN 0
  WHEN event_id // 40 % 5 = 2 AND event_id % 8 <> 0 THEN 7 ELSE event_id % 8 END AS kind FROM events),
told AS (SELECT sample, count(*) FILTER (WHERE kind = 0) AS json, count(*) AS n, arg_min(kind, event_id) FILTER (WHERE kind NOT IN (0, 7)) AS other FROM lines GROUP BY sample)
SELECT sample, CASE WHEN json > 0.7 * n THEN 'json' WHEN other IS NOT NULL THEN ['json','logfmt','apache-combined','python-logging','log4j','go-logrus','syslog','raw'][other + 1] ELSE 'raw' END AS format FROM told""")
def detect_sample(spark, sf_dir):
    """Samples of forty lines: mixed, all JSON, JSON and text, three quarters and two
    thirds of JSON."""
    n = F.col("event_id")
    turn = F.floor(n / 40) % 5
    line = F.when((turn == 1) | ((turn == 3) & (n % 4 != 3)) | ((turn == 4) & (n % 10 < 6)), ' {"n":1}').when((turn == 2) & (n % 8 != 0), "plain words").otherwise(F.col("line"))
    rows = event_lines(spark, sf_dir).select("event_id", line.alias("line"))
    samples = rows.groupBy(F.floor(n / 40).alias("sample")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]).alias("lines"))
    return samples.select("sample", parse.detect_sample(F.col("lines")).alias("format"))


# ----------------------------------------------------------------- full text
def _search(name: str, where: str, text: str, limit: int = 2000) -> None:
    query(name, over(_ROWS + where + _NEWEST + str(limit)))(lambda spark, sf_dir: search.search(event_logs(spark, sf_dir), ask(query=text), limit).select(*_PAGE))


_has = lambda words: f"{_TOKENS} LIKE '% {words} %'"
_search("search_and_before_or", f"({_has('timeout')} AND {_has('internal')}) OR {_has('refused')}", "timeout AND internal OR refused")
_search("search_or_then_and", f"{_has('refused')} OR ({_has('timeout')} AND {_has('db 3')})", "refused OR timeout AND db-3")
_search("search_and_not", f"({_has('worker')} AND NOT {_has('worker 8')}) OR ({_has('timeout')} AND ({_has('db 1')} OR {_has('db 2')}))", "worker AND NOT \"worker 8\" OR timeout AND (db-1 OR db-2)")
_search("search_boosted", f"({_has('no such')} OR {_has('refused')}) AND level = 'error' AND status_code BETWEEN 501 AND 503", '+("no such"^2 refused^0.5)^3 +level:error +status_code:[501 TO 503]')


def _bm25_sql(text: str, limit: int) -> str:
    """BM25 over the tokens of all rows, as ``fulltext.ranked`` states it."""
    weights = fulltext.terms(fulltext.parse(text))
    tf = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
    stats = ", ".join(f"sum(CASE WHEN list_contains(t, '{w}') THEN 1 ELSE 0 END) AS df_{w}" for w in weights)
    score = " + ".join(f"{weight} * ln(1 + (n - df_{w} + 0.5) / (df_{w} + 0.5)) * {tf(w)} * {fulltext.K1 + 1} / ({tf(w)} + {fulltext.K1} * (1 - {fulltext.B} + {fulltext.B} * len(t) / mean))" for w, weight in weights.items())
    more = f", worded AS (SELECT *, string_split(trim({_TOKENS}), ' ') AS t FROM logs), counted AS (SELECT count(*) AS n, avg(len(t)) AS mean, {stats} FROM worded), scored AS (SELECT w.*, {score} AS score FROM worded w, counted WHERE {' OR '.join(_has(w) for w in weights)})"
    return over(f"SELECT {', '.join(_PAGE)}, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, timestamp DESC, log_id LIMIT {limit}", more=more)


def _ranked(name: str, text: str, limit: int) -> None:
    def run(spark, sf_dir):
        found = search.search(event_logs(spark, sf_dir), ask(query=text), limit, by_relevance=True)
        return found.select(*_PAGE, F.round("score", 6).alias("score"))

    query(name, _bm25_sql(text, limit))(run)


_ranked("search_relevance", "timeout internal worker", 50)
_ranked("search_relevance_boosted", "timeout^0.5 refused^3 job", 80)


# ------------------------------------------------------------ mining, learning
_MINED = """ , fed AS (SELECT *, CASE WHEN message LIKE 'GET %' THEN 'GET <path> in <dur>' WHEN message LIKE 'Conn%' THEN 'Connection timeout to db-<num>.internal after <dur>'
  WHEN message LIKE 'Worker %' THEN 'Worker <num> died: no such job' ELSE 'Login of <str> refused from <ip>' END AS template FROM (SELECT * FROM logs @@ ORDER BY timestamp DESC, ingest_seq DESC LIMIT 50000))"""
_MINED_ROWS = """SELECT 'v1:' || substr(sha256(template), 1, 16) AS template_id, template, count(*) AS count, round(count(*) * 1000.0 / (SELECT count(*) FROM fed)) / 10 AS share, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  arg_min(message, timestamp || lpad(CAST(ingest_seq AS VARCHAR), 12, '0')) AS example, array_to_string(list(log_id ORDER BY timestamp, ingest_seq)[1:3], ',') AS samples FROM fed GROUP BY template"""


def _mined(name: str, where: str = "", **fields) -> None:
    def run(spark, sf_dir):
        found = drain.patterns(ask(**fields).apply(event_logs(spark, sf_dir)))
        return found.select("template_id", "template", "count", "share", "first_seen", "last_seen", "example", F.array_join("samples", ",").alias("samples"))

    query(name, over(_MINED_ROWS, more=_MINED.replace("@@", where)))(run)


_mined("patterns_drain")
_mined("patterns_of_errors", f"WHERE level = 'error' AND timestamp_ms >= {NOW_MS} - 12 * 86400000", level="error", last="12d")

_PIPES, _BRACKETS = r"^(?P<timestamp>.*?)\ \|\ (?P<level>.*?)\ \|\ (?P<source>.*?)\ \|\ (?P<message>.*)$", r"^\[(?P<timestamp>[^\]]*)\]\s*\[(?P<level>[^\]]*)\]\s*(?P<message>.*)$"
_COLONS = r"^(?P<method>.*?)\ ::\ (?P<status>.*?)\ ::\ (?P<source>.*?)\ ::\ (?P<message>.*)$"


@query("learn_regex", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{_PIPES}' WHEN 1 THEN '{_BRACKETS}' WHEN 2 THEN '{_COLONS}' ELSE '^(?P<message>.*)$' END AS pattern, CASE event_id % 4 WHEN 0 THEN 0.92 :: DOUBLE WHEN 1 THEN 0.98 WHEN 2 THEN 0.81 ELSE 0.25 END AS confidence, ['timestamp,level,source,message', 'timestamp,level,message', 'method,status,source,message', 'message'][event_id % 4 + 1] AS fields FROM events")
def learn_regex(spark, sf_dir):
    """Suggestions for samples of four shapes, one of which has none."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    at, kind = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    line = F.when(n % 4 == 0, join(at, " | WARN | svc.", kind, " | took ", n, " ms")).when(n % 4 == 1, join("[", at, "] [INFO] user ", n, " came")).when(n % 4 == 2, join("GET :: ", 200 + n % 300, " :: api/", kind, " :: went ", n)).otherwise(join("words ", n, " without a shape"))
    found = learn.learn(e.select("event_id", line.alias("line")), "event_id", "line")
    return found.select(F.col("key").alias("event_id"), "pattern", "confidence", F.array_join("fields", ",").alias("fields"))


@query("schema_profile", over("""SELECT field, sum(n) AS count, CASE WHEN count(*) >= 1000 THEN '1000+' ELSE CAST(count(*) AS VARCHAR) END AS distinct_values, arg_max(type, newest) AS type,
  array_to_string(list(value ORDER BY newest DESC, value)[1:3], '|') AS samples
FROM (SELECT field, value, count(*) AS n, max(timestamp || log_id) AS newest, any_value(type) AS type FROM cells WHERE value IS NOT NULL GROUP BY field, value) GROUP BY field""",
    more=", newest AS (SELECT * FROM logs ORDER BY timestamp DESC, log_id LIMIT 10000), cells AS (" + " UNION ALL ".join(
        f"SELECT '{n.replace('error_', 'error.')}' AS field, '{k}' AS type, CAST({n} AS VARCHAR) AS value, timestamp, log_id FROM newest"
        for n, k in aggregate.PROFILE_FIELDS.items() if n not in ("source_file", "line_number")) + " UNION ALL SELECT 'attributes.k', 'number', regexp_extract(attributes, '(-?[0-9]+)', 1), timestamp, log_id FROM newest)"))
def schema_profile(spark, sf_dir):
    return aggregate.profile(event_logs(spark, sf_dir)).withColumn("samples", F.array_join("samples", "|"))


# ------------------------------------------------------------- whole commands
class _Shell:
    """Commands in a project of their own below the shared folder."""

    def __init__(self, spark):
        self.spark, self.root = spark, f"{shared_folder(spark)}/project-{uuid.uuid4().hex[:12]}"
        os.makedirs(f"{self.root}/logs")
        self.told: list[tuple[str, str, str]] = []

    def write(self, name: str, lines: list[str]) -> None:
        with open(f"{self.root}/logs/{name}", "w") as f:
            f.writelines(f"{line}\n" for line in lines)

    def write_rows(self, logs: DataFrame) -> list[str]:
        """The rows as JSON lines in three files, written by Spark."""
        names = "timestamp", "level", "message", "request_id", "user_id", "route", "status_code"
        logs.select(F.to_json(F.struct(*names))).repartition(3).write.text(f"file://{self.root}/written")
        found = sorted(n for n in os.listdir(f"{self.root}/written") if n.startswith("part-"))
        paths = [f"{self.root}/logs/api-{k}.log" for k in range(len(found))]
        for name, path in zip(found, paths):
            os.replace(f"{self.root}/written/{name}", path)
        return paths

    def __call__(self, *argv: str, said: str = "") -> dict:
        out, self.err = io.StringIO(), io.StringIO()
        code = cli.main(list(argv), self.spark, self.root, NOW_MS, out, self.err, io.StringIO(said))
        self.out = out.getvalue()
        return {"exit": code} | (json.loads(self.out) if self.out.startswith("{") and self.out.count("\n") == 1 else {})

    def tell(self, step: str, values: dict) -> None:
        self.told += [(step, k, json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else str(v)) for k, v in values.items()]

    def result(self) -> DataFrame:
        return self.spark.createDataFrame(self.told, "step string, measure string, value string")


_say = lambda step, measure, value: f"SELECT '{step}' AS step, '{measure}' AS measure, CAST({value} AS VARCHAR) AS value"


@query("commands_read", over(" UNION ALL ".join([
    _say("search", "exit", "0"), _say("search", "ingested", "(SELECT count(*) FROM logs)"), _say("search", "count", "7"), _say("search", "total", "(SELECT count(*) FROM logs WHERE level = ''error'')".replace("''", "'")), _say("search", "filters", "'{\"level\": \"error\"}'"),
    _say("search", "start", "(SELECT min(timestamp) FROM (SELECT timestamp FROM logs WHERE level = 'error' ORDER BY timestamp DESC LIMIT 7))"), _say("search", "end", "(SELECT max(timestamp) FROM logs WHERE level = 'error')"),
    _say("again", "reason", "'fresh'"), _say("again", "keys", "'command,data,elapsed_ms,generated_at,meta,ok,sync,version'"),
    _say("more", "ingested", "3"), _say("more", "total", "(SELECT count(*) FROM logs) + 3"),
    _say("rotated", "ingested", "2"), _say("rotated", "total", "(SELECT count(*) FROM logs) + 5"),
    _say("stats", "by_level", "(SELECT '{' || string_agg('\"' || level || '\": ' || n, ', ' ORDER BY level) || '}' FROM (SELECT level, count(*) + CASE level WHEN 'info' THEN 5 ELSE 0 END AS n FROM logs GROUP BY level))"),
    _say("none", "exit", "2"), _say("none", "total", "0"), _say("usage", "exit", "3"), _say("usage", "code", "'usage'"), _say("relevance", "code", "'usage'"),
    _say("health", "checks", "'{\"index\": \"healthy\", \"lock\": \"healthy\", \"sources\": \"healthy\"}'"),
    _say("off", "reason", "'disabled'"), _say("status", "documents", "(SELECT count(*) FROM logs) + 5"), _say("status", "schema_version", "6"),
])))
def commands_read(spark, sf_dir):
    """Sync before reads, rotation, totals, filters, envelopes and exit codes."""
    shell = _Shell(spark)
    shell.write_rows(event_logs(spark, sf_dir))
    later = [json.dumps({"timestamp": f"2024-01-30T23:59:5{k}Z", "level": "info", "message": f"later {k}"}) for k in range(5)]
    doc = shell("search", "--level", "error", "--limit", "7")
    shell.tell("search", {"exit": doc["exit"], "ingested": doc["sync"]["ingested"]} | {k: doc["meta"][k] for k in ("count", "total", "filters")} | doc["meta"]["time_range"])
    doc = shell("search")
    shell.tell("again", {"reason": doc["sync"]["reason"], "keys": ",".join(sorted(k for k in doc if k not in ("exit", "notices")))})
    shell.write("more.log", later[:3])
    doc = shell("search")
    shell.tell("more", {"ingested": doc["sync"]["ingested"], "total": doc["meta"]["total"]})
    shell.write("more.log", later[3:])
    doc = shell("search")
    shell.tell("rotated", {"ingested": doc["sync"]["ingested"], "total": doc["meta"]["total"]})
    shell.tell("stats", {"by_level": shell("stats", "--by-level")["data"]["by_level"]})
    doc = shell("search", "-q", "nowhere")
    shell.tell("none", {"exit": doc["exit"], "total": doc["meta"]["total"]})
    doc = shell("search", "--status", "599-500")
    shell.tell("usage", {"exit": doc["exit"], "code": doc["error"]["code"]})
    shell.tell("relevance", {"code": shell("search", "--sort", "relevance")["error"]["code"]})
    shell.tell("health", {"checks": {c["name"]: c["status"] for c in shell("health")["data"]["checks"] if c["name"] != "disk"}})
    shell.tell("off", {"reason": shell("stats", "--no-sync")["sync"]["reason"]})
    shell.tell("status", {k: shell("index", "status")["data"][k] for k in ("documents", "schema_version")})
    return shell.result()


@query("commands_write", over(" UNION ALL ".join([
    _say("ingest", "entries_indexed", "(SELECT count(*) FROM logs)"), _say("ingest", "entries_deduplicated", "0"), _say("again", "entries_indexed", "(SELECT count(*) FROM logs)"), _say("again", "entries_deduplicated", "(SELECT count(*) FROM logs)"),
    _say("rebuild", "entries_indexed", "(SELECT count(*) FROM logs)"), _say("rebuild", "files", "3"),
    _say("dry", "would_delete", "(SELECT count(*) FROM old)"), _say("asked", "exit", "3"), _say("clean", "deleted", "(SELECT count(*) FROM old)"), _say("clean", "cutoff", "'2024-01-16T00:00:00.000Z'"),
    _say("left", "documents", "(SELECT count(*) FROM logs) - (SELECT count(*) FROM old)"), _say("missing", "code", "'io_error'"),
    _say("patterns", "total_logs", "(SELECT count(*) FROM logs WHERE timestamp_ms >= 1706659200000 - 10 * 86400000)"), _say("patterns", "sum", "(SELECT count(*) FROM logs WHERE timestamp_ms >= 1706659200000 - 10 * 86400000)"), _say("patterns", "share", "100"),
    _say("errors", "total_errors", "(SELECT count(*) FROM logs WHERE level = 'error' AND timestamp_ms >= 1706659200000 - 10 * 86400000)"),
    _say("learn", "fields", "'[\"timestamp\", \"level\", \"message\"]'"),
]), more=", old AS (SELECT * FROM logs WHERE timestamp <= '2024-01-16T00:00:00.000Z')"))
def commands_write(spark, sf_dir):
    """Ingest twice, rebuild, clean; patterns and errors over what is left."""
    shell = _Shell(spark)
    files = shell.write_rows(event_logs(spark, sf_dir))
    for step in ("ingest", "again"):
        data = [shell("ingest", f, "--source", "api")["data"] for f in files]
        shell.tell(step, {k: sum(d[k] for d in data) for k in ("entries_indexed", "entries_deduplicated")})
    data = shell("index", "rebuild")["data"]
    shell.tell("rebuild", {k: data[k] for k in ("entries_indexed", "files")})
    os.makedirs(f"{shell.root}/.timberline", exist_ok=True)
    with open(f"{shell.root}/.timberline/config.toml", "w") as f:
        f.write("[general]\nretention_days = 15\n")
    shell.tell("dry", {"would_delete": shell("index", "clean", "--dry-run")["data"]["would_delete"]})
    shell.tell("asked", {"exit": shell("index", "clean")["exit"]})
    data = shell("index", "clean", "--force")["data"]
    shell.tell("clean", {k: data[k] for k in ("deleted", "cutoff")})
    shell.tell("left", {"documents": shell("index", "status")["data"]["documents"]})
    shell.tell("missing", {"code": shell("ingest", f"{shell.root}/absent.log")["error"]["code"]})
    data = shell("patterns", "--last", "10d", "--limit", "1000", "--no-sync")["data"]
    shell.tell("patterns", {"total_logs": data["total_logs"], "sum": sum(t["count"] for t in data["templates"]), "share": round(sum(t["share_pct"] for t in data["templates"]))})
    shell.tell("errors", {"total_errors": shell("errors", "--last", "10d", "--no-sync")["data"]["total_errors"]})
    shell.tell("learn", {"fields": shell("learn", "--sample", "[2024-03-25 10:00:00] [INFO] started")["data"]["suggestions"][0]["fields"]})
    return shell.result()


_TAPPED = ['{"timestamp":"2024-01-30T23:58:00Z","level":"info","message":"a"}', "TypeError: x is not a function", "  at f (a.js:1:2)", "", "  error: labelled", '{"timestamp":"2024-01-30T23:59:00Z","level":"error","message":"lost 5"}']


@query("commands_stream", " UNION ALL ".join([
    _say("tap", "exit", "0"), _say("tap", "passed", "true"), _say("tap", "lines", "6"), _say("tap", "entries_indexed", "4"), _say("tap", "indexed_inline", "true"), _say("tap", "source", "'dev'"),
    _say("after", "reason", "'fresh'"), _say("after", "total", "4"), _say("after", "messages", "'[\"TypeError: x is not a function\\n  at f (a.js:1:2)\", \"a\", \"error: labelled\", \"lost 5\"]'"),
    _say("locked", "reason", "'locked'"), _say("locked", "notice", "'sync_deferred'"), _say("locked", "exit", "4"), _say("locked", "indexed_inline", "false"),
    _say("watch", "ingested", "1"), _say("watch", "rounds", "1"), _say("names", "sources", "'[\"dev\", \"own\"]'"),
    _say("alert", "template", "'lost <num>'"), _say("alert", "count", "1"), _say("alert", "again", "''"),
    _say("broken", "code", "'config_invalid'"), _say("broken", "exit", "3"),
]))
def commands_stream(spark, sf_dir):
    """Tap, journal, lock, watch, discovery of sources, alert, broken settings."""
    shell = _Shell(spark)
    said = "".join(f"{line}\n" for line in _TAPPED)
    code = shell("tap", "-s", "Dev", said=said)["exit"]
    told = json.loads(shell.err.getvalue())["data"]
    with open(f"{shell.root}/.timberline/streams/dev.jsonl") as f:
        passed = shell.out == said == f.read()
    shell.tell("tap", {"exit": code, "passed": str(passed).lower()} | {k: str(told[k]).lower() for k in ("lines", "entries_indexed", "indexed_inline", "source")})
    doc = shell("search")
    shell.tell("after", {"reason": doc["sync"]["reason"], "total": doc["meta"]["total"], "messages": sorted(r["message"] for r in doc["data"]["results"])})
    shell.write("own.log", ["one more"])
    with Project.load(shell.root).lock():
        doc = shell("stats")
        shell("tap", "-s", "dev", said="")
        told = json.loads(shell.err.getvalue())["data"]
        shell.tell("locked", {"reason": doc["sync"]["reason"], "notice": doc["notices"][0]["code"], "exit": shell("index", "rebuild")["exit"], "indexed_inline": str(told["indexed_inline"]).lower()})
    data = shell("watch", "--rounds", "1")["data"]
    shell.tell("watch", {k: data[k] for k in ("ingested", "rounds")})
    shell.tell("names", {"sources": sorted(s.name for s in Project.load(shell.root).sources())})
    logs, state = Project.load(shell.root).table(spark).read().where("parse_format = 'json'"), f"{shell.root}/alert.json"
    first, again = (alert.alert(spark, logs, state, NOW_MS, 60.0) for _ in range(2))
    shell.tell("alert", {"template": first["template"], "count": first["count"], "again": again or ""})
    with open(f"{shell.root}/.timberline/config.toml", "w") as f:
        f.write("general = 3 =")
    doc = shell("stats")
    shell.tell("broken", {"code": doc["error"]["code"], "exit": doc["exit"]})
    return shell.result()

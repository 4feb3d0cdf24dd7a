"""The commands: ``python -m timberline.cli search --level error --last 1h``.

Each prints one JSON document (or a record per line with ``--format jsonl``) and
ends with the exit code of its outcome. What is collected here is a page, a list of
groups or counts per value; everything else stays in Spark.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from timberline import project as control
from timberline.envelope import EMPTY, EXIT_CODES, CommandError, Envelope, classify, dumps, entry, list_meta
from timberline.operators import drain
from timberline.operators.learn import suggest_patterns
from timberline.plans import aggregate, search
from timberline.plans.alert import alert
from timberline.plans.filters import LogQuery, status_range
from timberline.schema import SCHEMA_VERSION
from timberline.sources.discover import Source
from timberline.streaming.tap import tap

#: Time formats that are told of.
TIME_FORMATS = ["ISO 8601 / RFC 3339", "epoch seconds", "epoch milliseconds", "relative: 15m, 24h, 7d, 2w"]
READS = {"search", "get", "stats", "errors", "patterns", "schema", "health"}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise CommandError("usage", message, f"See {self.prog} --help.")


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--format", choices=["json", "jsonl"], default="json")
    shared.add_argument("--quiet", action="store_true")
    shared.add_argument("--no-sync", action="store_true")
    top = _Parser(prog="timberline")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    add = lambda name: commands.add_parser(name, parents=[shared])

    def shown(p) -> None:
        p.add_argument("--compact", action="store_true")
        p.add_argument("--fields", type=lambda x: [f.strip() for f in x.split(",")])

    p = add("search")
    for short, name in (("-q", "query"), ("-L", "level"), ("-R", "request-id"), ("-U", "user-id"), ("-r", "route"), ("-s", "start"), ("-e", "end"), ("-l", "last")):
        p.add_argument(short, f"--{name}")
    for name in ("source", "method", "parse-format", "status"):
        p.add_argument(f"--{name}")
    p.add_argument("--slow-above", type=float)
    p.add_argument("--sort", choices=["time", "relevance"], default="time")
    p.add_argument("-n", "--limit", type=int, default=search.DEFAULT_LIMIT)
    p.add_argument("-o", "--offset", type=int, default=0)
    p.add_argument("--context", type=int)
    shown(p)
    p = add("get")
    p.add_argument("log_id", nargs="?")
    p.add_argument("-R", "--request-id")
    p.add_argument("-U", "--user-id")
    shown(p)
    p = add("stats")
    for name in ("by-level", "by-route", "by-user", "by-format", "errors-only"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("-l", "--last")
    p = add("errors")
    p.add_argument("-l", "--last", default="24h")
    p.add_argument("-n", "--limit", type=int, default=10)
    p = add("patterns")
    p.add_argument("-l", "--last", default="24h")
    p.add_argument("-n", "--limit", type=int, default=20)
    p.add_argument("--source")
    p.add_argument("-L", "--level")
    add("schema")
    add("health")
    p = add("ingest")
    p.add_argument("file_pos", nargs="?", metavar="FILE")
    p.add_argument("-f", "--file")
    p.add_argument("-s", "--source")
    p = add("tap")
    p.add_argument("-s", "--source", default="stdin")
    p = add("watch")
    p.add_argument("--interval", type=int)
    p.add_argument("--rounds", type=int, help="end after so many rounds")
    p.add_argument("-f", "--file")
    p.add_argument("-s", "--source")
    p = add("learn")
    p.add_argument("--sample", required=True)
    add("alert")
    p = add("index")
    p.add_argument("action", choices=["rebuild", "status", "clean"])
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    return top


class Run:
    """One invocation. ``spark`` is made when a command first needs it."""

    def __init__(self, args: argparse.Namespace, project: control.Project, now_ms: int, spark: SparkSession | None, out, err, stdin):
        self.args, self.project, self.now_ms, self._spark = args, project, now_ms, spark
        self.out, self.err, self.stdin = out, err, stdin
        self.envelope = Envelope(args.command)

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.appName("timberline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
            self._spark.sparkContext.setLogLevel("ERROR")
        return self._spark

    def say(self, text: str) -> None:
        if not self.args.quiet:
            print(text, file=self.err)

    def emit(self, data, meta: dict | None = None, records: list | None = None) -> None:
        if self.args.format == "jsonl" and records is not None:
            for r in records:
                print(dumps(r), file=self.out)
        else:
            print(self.envelope.render(data, meta), file=self.out)

    def logs(self) -> DataFrame:
        return self.project.table(self.spark).read()

    def sync(self) -> None:
        report = control.sync(self.spark, self.project, self.now_ms, not self.args.no_sync)
        self.envelope.sync = report
        if report["reason"] == "locked":
            self.envelope.notice("sync_deferred", "Another process is writing; the results may be a little old.")
        if report.get("migrated"):
            self.envelope.notice("index_migrated", "The table was rebuilt for the current schema.")

    def query(self, *names: str, **more) -> LogQuery:
        asked = {n: getattr(self.args, n) for n in names if getattr(self.args, n, None) is not None}
        return LogQuery(now_ms=self.now_ms, **asked, **more)

    # ---------------------------------------------------------------- reads
    def search(self) -> int:
        a = self.args
        if a.status is not None:
            try:
                status_range(a.status)
            except ValueError as e:
                raise CommandError("usage", str(e), "Give a code or a range: 500 or 500-599.") from e
        if a.sort == "relevance" and a.query is None:
            raise CommandError("usage", "--sort relevance needs --query", "Add --query, or leave --sort out.")
        q = self.query("query", "level", "request_id", "user_id", "route", "source", "method", "parse_format", "status", "slow_above", "start", "end", "last")
        logs = self.logs()
        page = search.search(logs, q, a.limit, max(0, a.offset), a.sort == "relevance").collect()
        show = lambda r: entry(r.asDict(), a.fields, a.compact)
        results = [show(r) for r in page]
        if a.context is not None and page:
            results = self._around(logs, page, a.context, show)
        stamps = [r["timestamp"] for r in page]
        meta = list_meta(len(page), q.apply(logs).count(), q.echo(), search.page_size(a.limit), a.offset, {"start": min(stamps), "end": max(stamps)} if stamps else None)
        self.emit({"results": results}, meta, results)
        return 0 if page else EMPTY

    def _around(self, logs: DataFrame, page: list, n: int, show) -> list[dict]:
        targets = self.spark.createDataFrame([(r["log_id"], r["timestamp"]) for r in page], "log_id string, timestamp string")
        near = search.context(logs, targets, n).collect()  # at most 2 n rows per row of the page
        ids = sorted({r["log_id"] for r in near})
        wanted = self.spark.createDataFrame([(i,) for i in ids], "log_id string")
        rows = {r["log_id"]: show(r) for r in logs.join(wanted, "log_id", "left_semi").collect()} if ids else {}
        side = lambda target, name: [rows[r["log_id"]] for r in sorted((r for r in near if (r["target"], r["side"]) == (target, name)), key=lambda r: r["position"], reverse=name == "before")]
        return [{"target": show(r), "before": side(r["log_id"], "before"), "after": side(r["log_id"], "after")} for r in page]

    def get(self) -> int:
        a = self.args
        if sum(x is not None for x in (a.log_id, a.request_id, a.user_id)) != 1:
            raise CommandError("usage", "Give exactly one of LOG_ID, --request-id, --user-id")
        q = self.query("log_id", "request_id", "user_id")
        found = [entry(r.asDict(), a.fields, a.compact) for r in search.get(self.logs(), q).collect()]
        total = q.apply(self.logs()).count() if len(found) == search.MOST else len(found)
        self.emit({"results": found}, list_meta(len(found), total, q.echo()), found)
        return 0 if found else EMPTY

    def stats(self) -> int:
        a = self.args
        asked = {n: c for n, c in (("by_level", "level"), ("by_route", "route"), ("by_user", "user_id"), ("by_format", "parse_format")) if getattr(a, n)}
        asked = asked or {"by_level": "level"}
        q = self.query("last", **({"level": "error"} if a.errors_only else {}))
        counts = aggregate.stats_of(q.apply(self.logs()), list(asked.values())).collect()  # one row per value
        by = {n: {r["value"]: r["count"] for r in counts if r["dimension"] == c} for n, c in asked.items()}
        total = sum(next(iter(by.values())).values())
        data = {"total_logs": total} | by
        self.emit(data, {"filters": q.echo()}, [data])
        return 0 if total else EMPTY

    def errors(self) -> int:
        q = self.query("last")
        kept = q.apply(self.logs())
        groups = aggregate.error_groups(kept, max(1, self.args.limit)).collect()
        names = {"name": "error_name", "message": "error_message", "samples": "sample_log_ids"}
        shown = [{names.get(k, k): v for k, v in r.asDict().items()} for r in groups]
        total = kept.where("level = 'error'").count()
        self.emit({"total_errors": total, "total_groups": len(shown), "groups": shown}, list_meta(len(shown), len(shown), q.echo() | {"level": "error"}, self.args.limit), shown)
        return 0 if shown else EMPTY

    def patterns(self) -> int:
        a = self.args
        q = self.query("last", "source", **({"level": a.level.lower()} if a.level else {}))
        kept = q.apply(self.logs())
        total = kept.count()
        names = {"share": "share_pct", "example": "sample_message", "samples": "sample_log_ids"}
        mined = [{names.get(k, k): v for k, v in r.asDict().items() if k != "n_tokens"} for r in drain.patterns(kept, None, max(1, a.limit)).collect()] if total else []
        self.emit({"total_logs": total, "scanned": total, "total_templates": len(mined), "templates": mined}, list_meta(len(mined), len(mined), q.echo(), a.limit), mined)
        return 0 if mined else EMPTY

    def schema(self) -> int:
        logs = self.logs()
        fields = [{"name": r["field"], "type": r["type"], "count": r["count"], "cardinality": r["distinct_values"], "samples": r["samples"]} for r in aggregate.profile(logs).orderBy("field").collect()]
        measured = {r["measure"]: r["value"] for r in aggregate.index_stats(logs).collect()}
        kinds = lambda kind: {k.split(":", 1)[1]: int(v) for k, v in measured.items() if k.startswith(f"{kind}:")}
        total = int(measured["total"])
        if total > aggregate.PROFILE_ROWS:
            self.envelope.notice("sampled", f"Fields are profiled on the newest {aggregate.PROFILE_ROWS} of {total} rows.")
        stats = {"total": total, "oldest": measured["oldest"], "newest": measured["newest"], "sources": sorted(kinds("source")), "levels": kinds("level")}
        now = datetime.fromtimestamp(self.now_ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.emit({"index_path": self.project.index_path, "system_info": {"current_time_utc": now, "timezone": "UTC"}, "schema": {"version": SCHEMA_VERSION, "fields": fields, "index_stats": stats, "supported_time_formats": TIME_FORMATS}})
        return 0

    def health(self) -> int:
        found = control.health(self.spark, self.project)
        self.emit(found)
        return 1 if found["status"] == "unhealthy" else 0

    # --------------------------------------------------------------- writes
    def _file(self) -> Source:
        a = self.args
        where = os.path.realpath(a.file)
        if not os.path.isfile(where):
            raise CommandError("io_error", f"There is no file {a.file}")
        return Source((a.source or os.path.splitext(os.path.basename(where))[0]).lower(), where)

    def ingest(self) -> int:
        a = self.args
        if (a.file is None) == (a.file_pos is None):
            raise CommandError("usage", "Give one file")
        a.file = a.file or a.file_pos
        source = self._file()
        with self.project.lock() as held:
            if not held:
                raise CommandError("index_locked", "Another process holds the writer's lock", "Stop the running watch or tap and try again.")
            size = os.path.getsize(source.path)
            table = self.project.table(self.spark)
            before = table.status()["documents"]
            put = control.ingest_files(self.spark, self.project, {source.path: (source.name, 0, size)}, self.now_ms)
            self.project.save_cursors(self.project.cursors() | {source.path: control.cursor(source.name, source.path, size)})
        grown = table.status()["documents"] - before
        self.emit({"source": source.name, "file": source.path, "entries_indexed": put["rows"], "entries_deduplicated": put["rows"] - grown, "entries_failed": 0})
        return 0

    def tap(self) -> int:
        done = tap(self.spark, self.project, self.args.source, self.stdin, self.out)
        print(self.envelope.render(done), file=self.err)
        return 0

    def watch(self) -> int:
        a = self.args
        if (a.file is None) != (a.source is None):
            raise CommandError("usage", "--file and --source go together")
        if a.file is not None:
            only = self._file()
            self.project.configured, self.project.sources = [(only.name, only.path)], lambda: [only]
        wait, rounds, ingested = max(1, a.interval or self.project.poll_seconds), 0, 0
        with self.project.lock() as held:
            if not held:
                raise CommandError("index_locked", "Another process holds the writer's lock")
            while a.rounds is None or rounds < a.rounds:
                if rounds:
                    time.sleep(wait)
                report = control.sync(self.spark, self.project, int(time.time() * 1000), locked=True)
                rounds, ingested = rounds + 1, ingested + report["ingested"]
                if report["ingested"]:
                    self.say(f"[INFO] {report['ingested']} entries")
        self.emit({"rounds": rounds, "ingested": ingested})
        return 0

    def learn(self) -> int:
        found = [{"pattern": p, "confidence": c, "fields": f} for p, c, f in suggest_patterns(self.args.sample)] if self.args.sample.strip() else []
        self.emit({"suggestions": found}, None, found)
        return 0 if found else EMPTY

    def alert(self) -> int:
        told = alert(self.spark, self.logs(), os.path.join(self.project.base, "alert.json"), self.now_ms)
        if told:
            self.emit({"alert": told}, None, [told])
        return 0

    def index(self) -> int:
        a, table = self.args, self.project.table(self.spark)
        if a.action == "status":
            self.emit({"action": "status", "path": self.project.index_path, "exists": table.exists(), "schema_version": SCHEMA_VERSION} | (table.status() if table.exists() else {"documents": 0, "size_mb": 0.0}))
        elif a.action == "rebuild":
            self.emit({"action": "rebuild"} | control.rebuild(self.spark, self.project, self.now_ms))
        else:
            self._clean(table)
        return 0

    def _clean(self, table) -> None:
        a, days = self.args, self.project.retention_days
        cutoff = datetime.fromtimestamp(self.now_ms / 1000 - days * 86400, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        data = {"action": "clean", "retention_days": days, "cutoff": cutoff}
        old = table.clean(days, self.now_ms, dry_run=True)
        if a.dry_run:
            return self.emit(data | {"dry_run": True, "would_delete": old})
        if old and not a.force:
            if not self.stdin.isatty():
                raise CommandError("usage", f"{old} entries would be deleted", "Pass --force to delete without being asked, or --dry-run to look.")
            print(f"Delete {old} entries of {cutoff} or before? [y/N] ", end="", file=self.err, flush=True)
            if self.stdin.readline().strip().lower() not in ("y", "yes"):
                return self.emit(data | {"deleted": 0, "message": "Nothing was deleted."})
        with self.project.lock() as held:
            if not held:
                raise CommandError("index_locked", "Another process holds the writer's lock")
            gone = table.clean(days, self.now_ms) if old else 0
        self.emit(data | {"deleted": gone, "journals_pruned": control.prune_journals(self.project, self.now_ms, days)})


def main(argv: list[str] | None = None, spark: SparkSession | None = None, root: str = ".", now_ms: int | None = None, out=None, err=None, stdin=None) -> int:
    """Run one command; returns its exit code."""
    out, err, stdin = out or sys.stdout, err or sys.stderr, stdin or sys.stdin
    envelope = Envelope("timberline")
    try:
        args = parser().parse_args(argv)
        envelope.command = args.command
        run = Run(args, control.Project.load(root), int(time.time() * 1000) if now_ms is None else now_ms, spark, out, err, stdin)
        if args.command in READS:
            run.sync()
        return getattr(run, args.command)()
    except Exception as e:  # noqa: BLE001 - every failure becomes a document and a code
        known = classify(e)
        print(envelope.render_error(known), file=out)
        return EXIT_CODES[known.code]


if __name__ == "__main__":
    sys.exit(main())

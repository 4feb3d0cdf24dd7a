"""A project's folder: settings, cursors, the writer's lock, sync and health.

Everything here is control: what grows with the logs runs as Spark jobs.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import tomllib
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from timberline.envelope import CommandError
from timberline.operators.ingest import ingest
from timberline.sources import tail
from timberline.sources.discover import JOURNALS, Source, discover
from timberline.streaming.table import LogTable

# Defaults of the settings, and limits of the disk check in MB.
RETENTION_DAYS, POLL_SECONDS, DISK_BAD, DISK_LOW = 30, 2, 500, 1024


@dataclass
class Project:
    root: str = "."
    base: str = ".timberline"
    retention_days: int = RETENTION_DAYS
    auto: bool = True
    poll_seconds: int = POLL_SECONDS
    index_path: str = ""
    configured: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, root: str = ".", base: str | None = None) -> Project:
        """Settings of ``<base>/config.toml``; CommandError where it is malformed."""
        base = base or os.environ.get("TIMBERLINE_BASE_DIR") or str(Path(root, ".timberline"))
        out = cls(root, base)
        file = Path(base, "config.toml")
        if file.exists():
            try:
                told = tomllib.loads(file.read_text())
                general, sync = told.get("general", {}), told.get("sync", {})
                out.index_path = str(general.get("index_path", ""))
                out.retention_days = int(general.get("retention_days", RETENTION_DAYS))
                out.auto, out.poll_seconds = bool(sync.get("auto", True)), max(1, int(sync.get("poll_interval_secs", POLL_SECONDS)))
                out.configured = [(str(s["name"]), str(s["path"])) for s in told.get("sources", [])]
            except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError, AttributeError) as e:
                raise CommandError("config_invalid", f"{file}: {e}", "Correct the file, or remove it to use the defaults.") from e
        out.index_path = os.path.abspath(out.index_path or Path(base, "index"))
        return out

    # -------------------------------------------------------------- cursors
    def cursors(self) -> dict:
        """Per canonical path what was read; a lost or broken file means none."""
        try:
            found = json.loads(Path(self.base, "state.json").read_text())
            return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            return {}

    def save_cursors(self, cursors: dict) -> None:
        os.makedirs(self.base, exist_ok=True)
        own = Path(self.base, f".state-{os.getpid()}")
        own.write_text(json.dumps(cursors, sort_keys=True))
        os.replace(own, Path(self.base, "state.json"))

    def sources(self) -> list[Source]:
        return discover(self.root, self.base, self.configured, [(c["source"], p) for p, c in self.cursors().items()])

    @contextmanager
    def lock(self):
        """True while this process is the one writer, False where another is."""
        os.makedirs(self.base, exist_ok=True)
        with open(Path(self.base, "writer.lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                held = True
            except BlockingIOError:
                held = False
            yield held

    def table(self, spark: SparkSession) -> LogTable:
        return LogTable(spark, self.index_path)


def cursor(source: str, path: str, end: int) -> dict:
    now = os.stat(path)
    return {"source": source, "offset": end, "size": now.st_size, "mtime_ms": now.st_mtime_ns // 1_000_000, "head": tail.head_hash(path, end), "head_size": end}


def _stale(source: Source, known: dict | None) -> bool:
    if known is None:
        return os.path.exists(source.path)
    return not tail.fresh(source.path, known["size"], known["mtime_ms"])


def ingest_files(spark: SparkSession, project: Project, spans: dict[str, tuple[str, int, int]], now_ms: int) -> dict:
    """Put ``{path: (source, start, end)}`` into the table: one job for all files."""
    spark.dataSource.register(tail.TailSource)
    lines = spark.read.format("tail").option("spans", json.dumps({p: [a, b] for p, (_, a, b) in spans.items()})).load()
    names = F.create_map(*(F.lit(x) for p, (name, _, _) in spans.items() for x in (p, name.lower())))
    return project.table(spark).merge(ingest(lines, F.lit(now_ms).cast("long"), F.element_at(names, F.col("path"))))


def sync(spark: SparkSession, project: Project, now_ms: int, enabled: bool = True, locked: bool = False) -> dict:
    """Read what is new before a command answers. A look at each file's size and
    time decides whether there is any; only then a job runs, and only where no
    other writer is at work (``locked``: the caller has the lock). A table of another
    schema version is rebuilt."""
    began = time.perf_counter()
    report = {"skipped": False, "reason": None, "files_checked": 0, "ingested": 0, "failed": 0}
    done = lambda **more: report | more | {"elapsed_ms": round((time.perf_counter() - began) * 1000, 2)}
    if not enabled or not project.auto:
        return done(skipped=True, reason="disabled")
    outdated = project.table(spark).outdated()
    known, found = {} if outdated else project.cursors(), project.sources()
    report["files_checked"] = len(found)
    stale = [s for s in found if _stale(s, known.get(s.path))]
    if not stale:
        return done(skipped=True, reason="fresh")
    with nullcontext(True) if locked else project.lock() as held:
        if not held:
            return done(skipped=True, reason="locked")
        spans = {}
        for s in stale:
            at = known.get(s.path)
            start = 0 if at is None or tail.rotated(s.path, at["offset"], at["head"]) else at["offset"]
            spans[s.path] = s.name, start, os.path.getsize(s.path)
        put = ingest_files(spark, project, spans, now_ms)
        project.save_cursors(known | {p: cursor(name, p, end) for p, (name, _, end) in spans.items()})
    return done(ingested=put["rows"], **({"migrated": True} if outdated else {}))


def rebuild(spark: SparkSession, project: Project, now_ms: int) -> dict:
    """Read all sources again into an empty table."""
    with project.lock() as held:
        if not held:
            raise CommandError("index_locked", "Another process holds the writer's lock", "Stop the running watch or tap and try again.")
        found = [s for s in project.sources() if os.path.exists(s.path)]
        project.table(spark).drop()
        spans = {s.path: (s.name, 0, os.path.getsize(s.path)) for s in found}
        put = ingest_files(spark, project, spans, now_ms) if spans else {"rows": 0}
        project.save_cursors({p: cursor(name, p, end) for p, (name, _, end) in spans.items()})
    return {"files": len(spans), "entries_indexed": put["rows"]}


def prune_journals(project: Project, now_ms: int, days: int) -> int:
    """Remove tap journals that nobody has written to for the retention's time."""
    old = [p for p in Path(project.base, JOURNALS).glob("*.jsonl") if p.stat().st_mtime * 1000 <= now_ms - days * 86_400_000]
    for p in old:
        p.unlink()
    return len(old)


# ------------------------------------------------------------------- health
def health(spark: SparkSession, project: Project) -> dict:
    """Four checks; the worst gives the status."""
    checks = [_check_index(spark, project), _check_sources(project), _check_disk(project), _check_lock(project)]
    worst = next((s for s in ("unhealthy", "degraded") if any(c["status"] == s for c in checks)), "healthy")
    return {"status": worst, "checks": checks}


def _check(name: str, status: str, details: str, data: dict | None = None) -> dict:
    return {"name": name, "status": status, "details": details} | ({"data": data} if data is not None else {})


def _check_index(spark: SparkSession, project: Project) -> dict:
    try:
        table = project.table(spark)
        status = table.status()
        table.read().limit(1).count()  # the files that the table names are there
    except Exception as e:  # noqa: BLE001 - whatever makes it unreadable is the finding
        return _check("index", "unhealthy", f"The table can't be read: {str(e).splitlines()[0]}")
    return _check("index", "healthy", f"{status['documents']} documents indexed", status | {"path": project.index_path})


def _check_sources(project: Project) -> dict:
    found = project.sources()
    if not found:
        return _check("sources", "degraded", "No log sources found", {"count": 0, "hint": f"Put log files in ./logs/, or name sources in {project.base}/config.toml"})
    missing = [f"{s.name} ({s.path})" for s in found if not os.path.exists(s.path)]
    there = len(found) - len(missing)
    return _check("sources", "healthy" if there else "degraded", f"{there} of {len(found)} sources readable", {"count": len(found), "missing": missing})


def disk_status(free_mb: int) -> str:
    return "unhealthy" if free_mb < DISK_BAD else "degraded" if free_mb < DISK_LOW else "healthy"


def _check_disk(project: Project) -> dict:
    try:
        free = shutil.disk_usage(project.index_path if os.path.exists(project.index_path) else project.root).free >> 20
    except OSError as e:
        return _check("disk", "unhealthy", f"The disk can't be checked: {e}")
    return _check("disk", disk_status(free), f"{free} MB available", {"available_mb": free})


def _check_lock(project: Project) -> dict:
    try:
        with project.lock() as held:
            return _check("lock", "healthy", "The writer's lock is free") if held else _check("lock", "healthy", "Another process holds the writer's lock", {"held": True})
    except OSError as e:
        return _check("lock", "degraded", f"The lock can't be checked: {e}")

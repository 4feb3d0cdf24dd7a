"""A tap: lines pass through, go to a journal, and into the table meanwhile.

The journal is a source like any other. A worker thread ingests its new bytes every
so many events or seconds, up to the start of the event that is still open, so no
event is cut and the cursor never passes what isn't in the table. Where another
writer holds the lock the journal alone grows, and the next sync reads it.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from timberline.functions.text import ANSI
from timberline.project import Project, cursor, ingest_files
from timberline.sources.discover import JOURNALS
from timberline.sources.tail import goes_on

# When new events are put into the table.
EVERY_EVENTS, EVERY_SECONDS = 500, 1.0
_ANSI = re.compile(ANSI)


class OpenEvent:
    """Where the event that may still grow begins, line by line."""

    def __init__(self) -> None:
        self.start: int | None = None
        self.events = 0

    def add(self, line: str, at: int) -> None:
        if not _ANSI.sub("", line).strip():
            self.start = None
        elif self.start is None or not goes_on(line):
            self.start, self.events = at, self.events + 1


def tap(spark: SparkSession, project: Project, source: str, lines: Iterable[str], out: TextIO, now_ms: int | None = None) -> dict:
    """Pass ``lines`` on to ``out`` until they end; returns the summary."""
    source = source.lower()
    folder = Path(project.base, JOURNALS)
    folder.mkdir(parents=True, exist_ok=True)
    path = os.path.realpath(folder / f"{source}.jsonl")
    known = project.cursors().get(path, {}).get("offset", 0)
    seen, indexed, done = 0, 0, known
    open_event, last, told = OpenEvent(), time.monotonic(), 0

    def put(start: int, end: int) -> int:
        rows = ingest_files(spark, project, {path: (source, start, end)}, now_ms if now_ms is not None else int(time.time() * 1000))["rows"]
        project.save_cursors(project.cursors() | {path: cursor(source, path, end)})
        return rows

    with project.lock() as held, open(path, "ab") as journal, ThreadPoolExecutor(1) as worker:
        at, running = journal.tell(), None
        done = min(done, at)
        for raw in lines:
            line = raw.rstrip("\n")
            seen += 1
            out.write(line + "\n")
            out.flush()
            journal.write(line.encode() + b"\n")
            journal.flush()
            open_event.add(line, at)
            at += len(line.encode()) + 1
            if not held:
                continue
            if running is not None and running.done():
                indexed, running = indexed + running.result(), None
            safe = at if open_event.start is None else open_event.start
            due = open_event.events - told >= EVERY_EVENTS or time.monotonic() - last >= EVERY_SECONDS
            if running is None and due and safe > done:
                running = _start(worker, put, done, safe)
                done, last, told = safe, time.monotonic(), open_event.events
        if running is not None:
            indexed += running.result()
        if held and at > done:
            indexed += put(done, at)
    return {"source": source, "journal": path, "lines": seen, "entries_indexed": indexed, "entries_failed": 0, "indexed_inline": held}


def _start(worker: ThreadPoolExecutor, put, start: int, end: int) -> Future:
    return worker.submit(put, start, end)

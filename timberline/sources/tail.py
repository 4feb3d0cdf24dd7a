"""Lines of growing files with their exact byte offsets, as a Python data source.

    spark.dataSource.register(TailSource)
    spark.read.format("tail").option("paths", "a.log,b.log").load()
    spark.readStream.format("tail").option("paths", "logs/*.log").load()

Rows: path, byte, line. Large files are read in ranges that begin after a line
end, so one file spreads over tasks. The stream's offset is the size of each file
with a hash of its head: a file that shrank, or whose head changed, is read again
from its start. The head that is compared never reaches past what was read, so a
small file that grows isn't taken for another.

With ``hold`` = ``line`` the last line waits until it is ended; with ``event`` the
last event waits as well, until another begins or the file rests for
``quietms``. With ``maxbytes`` the stream goes on by about that many bytes at a time:
``progress`` names a small file in the checkpoint's folder that tells a restarted
stream where it was. What is read twice after a loss is merged by identity.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from timberline.functions.text import ANSI
from timberline.operators.coalesce import DIAGNOSTIC, MAX_BYTES, MAX_LINES

#: Fixed value: bytes of a file's head that tell it from another.
HEAD_BYTES = 4096
RANGE_BYTES = 64 << 20


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    stop: int
    whole_line_first: bool  # the line that begins before ``start`` isn't ours
    end: int | None = None  # bytes of the file that count; a line that grows on is cut here


def paths_of(options: dict) -> list[str]:
    found = [p for part in options["paths"].split(",") for p in (glob.glob(part) or ([part] if os.path.exists(part) else []))]
    return sorted({os.path.realpath(p) for p in found if os.path.isfile(p)})


def head_hash(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(min(HEAD_BYTES, size))).hexdigest()[:16]


def rotated(path: str, size: int, head: str) -> bool:
    """Whether the file isn't the one of which ``size`` bytes were read."""
    if os.path.getsize(path) < size:
        return True
    return size > 0 and head_hash(path, size) != head


def fresh(path: str, size: int, mtime_ms: int) -> bool:
    """Whether nothing changed; what can't be read counts as unchanged."""
    try:
        now = os.stat(path)
    except OSError:
        return True
    return (now.st_size, now.st_mtime_ns // 1_000_000) == (size, mtime_ms)


def ranges(path: str, start: int, stop: int, each: int = RANGE_BYTES) -> list[FileRange]:
    return [FileRange(path, at, min(at + each, stop), at > start, stop) for at in range(start, stop, each)]


def read_range(part: FileRange) -> Iterator[tuple[str, int, str]]:
    """Lines that begin in the range; the last one may end beyond it, but not beyond
    the file's ``end``."""
    with open(part.path, "rb") as f:
        at = part.start
        if part.whole_line_first:
            f.seek(at - 1)
            at = at - 1 + len(f.readline())
        else:
            f.seek(at)
        while at < part.stop and (line := f.readline()):
            if part.end is not None:
                line = line[: part.end - at]
            yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


def last_line_end(path: str, start: int, size: int) -> int:
    """The end of the last ended line in path[start:size]."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            step = min(1 << 16, at - start)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return start


_ANSI, _DIAGNOSTIC = re.compile(ANSI), re.compile(DIAGNOSTIC)


def goes_on(line: str) -> bool:
    """Whether a line that isn't blank continues the event above it."""
    seen = _ANSI.sub("", line)
    return seen.startswith("Caused by") or (seen[:1] in (" ", "\t") and not _DIAGNOSTIC.match(seen.strip()))


def open_event(path: str, start: int, size: int) -> int:
    """Where the event begins that the line before ``size`` belongs to; ``size`` where
    a blank line has ended it. An event at its caps can't grow and isn't held."""
    with open(path, "rb") as f:
        begin = max(start, size - 2 * MAX_BYTES)
        f.seek(begin)
        lines = f.read(size - begin).splitlines(keepends=True)
    at = size
    for n, raw in enumerate(reversed(lines)):
        line = raw.decode("utf-8", "replace")
        if not _ANSI.sub("", line).strip() or n >= MAX_LINES or size - at >= MAX_BYTES:
            return at if n else size
        at -= len(raw)
        if not goes_on(line):
            return at
    return at


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        each = int(self.options.get("rangebytes", RANGE_BYTES))
        if "spans" in self.options:  # {path: [start, end]}, as a sync plans them
            return [r for p, (start, end) in json.loads(self.options["spans"]).items() for r in ranges(p, start, end, each)]
        return [r for p in paths_of(self.options) for r in ranges(p, int(self.options.get("start", 0)), os.path.getsize(p), each)]

    def read(self, partition):
        return read_range(partition) if partition is not None else iter(())


def _line_end_after(path: str, at: int) -> int:
    with open(path, "rb") as f:
        f.seek(at)
        f.readline()
        return f.tell()


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        before, files, taken = self._progress(), {}, 0
        most = int(self.options.get("maxbytes", 0))
        for path in paths_of(self.options):
            done, head = before.get(path, [0, ""])
            if done and rotated(path, done, head):
                done = 0
            size = max(done, self._end(path))  # what was read isn't held back again
            if most and size - done > most - taken:
                room = done + most - taken
                size = last_line_end(path, done, room)
                if size == done and not taken:  # a line that is longer than a batch
                    size = _line_end_after(path, room)
            taken += size - done
            files[path] = [size, head_hash(path, size)]
        self.last = files
        return {"files": files}

    def _end(self, path: str) -> int:
        now, hold = os.stat(path), self.options.get("hold", "")
        if hold not in ("line", "event", "true"):
            return now.st_size
        end = last_line_end(path, 0, now.st_size)
        quiet = time.time() * 1000 - now.st_mtime_ns / 1e6 >= int(self.options.get("quietms", 2000))
        if hold != "event":
            return end
        return now.st_size if quiet else open_event(path, 0, end)

    def _progress(self) -> dict:
        """Where the stream is: what it last offered, or after a restart what it last
        committed."""
        if self.last is None:
            try:
                with open(self.options["progress"]) as f:
                    self.last = json.load(f)
            except (KeyError, OSError, ValueError):
                self.last = {}
        return self.last

    def partitions(self, start: dict, end: dict):
        out = []
        for path, (size, head) in end["files"].items():
            before, known = start["files"].get(path, [0, ""])
            again = size < before or (before > 0 and os.path.exists(path) and head_hash(path, before) != known)
            out += ranges(path, 0 if again else before, size)
        return out

    def read(self, partition):
        return read_range(partition)

    def commit(self, end: dict) -> None:
        if "progress" in self.options:
            own = f"{self.options['progress']}.{os.getpid()}"
            with open(own, "w") as f:
                json.dump(end["files"], f)
            os.replace(own, self.options["progress"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, byte long, line string"

    def reader(self, schema):
        return TailReader(self.options)

    def streamReader(self, schema):
        return TailStreamReader(self.options)

"""Which files are sources, and what they are called."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

#: What a log file looks like, and where taps keep their journals.
SUFFIXES, JOURNALS = (".log", ".json", ".jsonl"), "streams"


@dataclass(frozen=True)
class Source:
    name: str
    path: str


def discover(project: str, base: str, configured: list[tuple[str, str]] = (), tracked: list[tuple[str, str]] = ()) -> list[Source]:
    """Configured sources, then ./logs/*, then tap journals, then tracked files;
    each canonical path once, under the first name; sorted by path."""
    root = Path(project)
    found = [(name, Path(path) if Path(path).is_absolute() else root / path) for name, path in configured]
    logs = root / "logs"
    found += [(p.stem, p) for p in sorted(logs.iterdir()) if p.suffix in SUFFIXES and p.is_file()] if logs.is_dir() else []
    journals = Path(base) / JOURNALS
    found += [(p.stem, p) for p in sorted(journals.glob("*.jsonl"))] if journals.is_dir() else []
    found += [(name, Path(path)) for name, path in tracked]
    out: dict[str, Source] = {}
    for name, path in found:
        where = str(path.resolve())
        out.setdefault(where, Source(name, where))
    return sorted(out.values(), key=lambda s: s.path)


def shared_folder(spark: SparkSession) -> str:
    """A mounted folder that driver and executors share: that of
    ``spark.checkpoint.dir``; a folder of this machine only where none is set and
    the session has no other machine. ValueError where there is no such folder."""
    named = urlsplit(spark.conf.get("spark.checkpoint.dir", None) or "")
    if named.scheme not in ("", "file"):
        raise ValueError(f"{named.geturl()} isn't a mounted folder; tables and journals need one")
    if named.path:
        return named.path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="timberline-")

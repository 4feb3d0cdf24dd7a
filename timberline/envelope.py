"""The JSON documents that commands print, their error codes and exit codes."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

VERSION = "0.1.0"
#: Exit codes of the error codes; EMPTY is the one of no results.
EXIT_CODES = {
    "usage": 3, "config_invalid": 3, "no_sources": 3, "index_locked": 4, "index_corrupt": 4,
    "permission_denied": 5, "io_error": 5, "parse_error": 6, "internal": 1,
}
EMPTY = 2
#: Keys of a printed row.
ENTRY_KEYS = ["log_id", "timestamp", "level", "source", "message", "request_id", "user_id", "route", "method", "status_code", "duration_ms", "error", "source_file", "line_number", "attributes", "parse_format"]


class CommandError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None):
        super().__init__(message)
        self.code, self.hint = code, hint


def classify(error: Exception) -> CommandError:
    """Any failure as one with a code."""
    if isinstance(error, CommandError):
        return error
    kinds = [(PermissionError, "permission_denied"), (OSError, "io_error")]
    return CommandError(next((code for kind, code in kinds if isinstance(error, kind)), "internal"), str(error))


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def generated_at() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class Envelope:
    def __init__(self, command: str):
        self.command, self.began = command, time.perf_counter()
        self.sync: dict | None = None
        self.notices: list[dict] = []

    def notice(self, code: str, message: str, hint: str | None = None) -> None:
        self.notices.append({"code": code, "message": message} | ({"hint": hint} if hint else {}))

    def render(self, data, meta: dict | None = None) -> str:
        body = {"ok": True, "command": self.command, "version": VERSION, "generated_at": generated_at(), "elapsed_ms": round((time.perf_counter() - self.began) * 1000, 2), "data": data}
        more = {"sync": self.sync, "meta": meta, "notices": self.notices or None}
        return dumps(body | {k: v for k, v in more.items() if v is not None})

    def render_error(self, error: CommandError) -> str:
        told = {"code": error.code, "message": str(error), "hint": error.hint, "exit_code": EXIT_CODES[error.code]}
        return dumps({"ok": False, "command": self.command, "generated_at": generated_at(), "error": told})


def entry(row: dict, fields: list[str] | None = None, compact: bool = False) -> dict:
    """A log row as it is printed: all keys, or the chosen ones (unknown names are
    ignored), without nulls where it is compact."""
    error = {"name": row.get("error_name"), "message": row.get("error_message"), "code": None}
    attributes = row.get("attributes")
    whole = {k: row.get(k) for k in ENTRY_KEYS}
    whole["error"] = error if error["name"] is not None or error["message"] is not None else None
    whole["attributes"] = json.loads(attributes) if attributes else None
    whole["parse_format"] = whole["parse_format"] or "raw"
    if fields:
        whole = {k: v for k, v in whole.items() if k in fields}
    return {k: v for k, v in whole.items() if v is not None} if compact else whole


def list_meta(count: int, total: int, filters: dict, limit: int | None = None, offset: int | None = None, time_range: dict | None = None) -> dict:
    more = {"limit": limit, "offset": offset, "time_range": time_range}
    return {"count": count, "total": total, "filters": filters} | {k: v for k, v in more.items() if v is not None}

"""Masks that turn the variable parts of a message into placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and placeholders, applied in this order. Group identity
# across runs depends on them.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b"
HEX = r"\b[0-9a-fA-F]{8,}\b"
QUOTED = "\"[^\"]*\"|'[^']*'"
NUMBER = r"\b\d+(\.\d+)?"
TIMESTAMP = r"\b\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\b"
PATH = r"/[\w.\-]+(/[\w.\-]+)+/?"
HOST = r"\b[A-Za-z0-9][A-Za-z0-9\-]*(\.[A-Za-z0-9\-]+){2,}\b"
DURATION = r"\b\d+(\.\d+)?(ns|us|µs|ms|s|m|h)\b"
TEMPLATE_STEPS = [(UUID, "<uuid>"), (IP, "<ip>"), (HEX, "<hex>"), (QUOTED, "<str>"), (NUMBER, "<num>")]
EXTENDED_STEPS = [
    (UUID, "<uuid>"), (TIMESTAMP, "<ts>"), (IP, "<ip>"), (PATH, "<path>"), (HOST, "<host>"),
    (HEX, "<hex>"), (QUOTED, "<str>"), (DURATION, "<dur>"), (NUMBER, "<num>"),
]


def unicode(pattern: str) -> str:
    """Java reads \\d, \\w and \\b as ASCII unless told otherwise."""
    return f"(?U){pattern}"


def _replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, placeholder in steps:
        text = F.regexp_replace(text, F.lit(unicode(pattern)), F.lit(placeholder))
    return text


def template(message: Column) -> Column:
    """The frozen mask: the key of error groups."""
    return _replace_all(message, TEMPLATE_STEPS)


def extended(message: Column) -> Column:
    """The mask for pattern mining; masking twice changes nothing."""
    return _replace_all(message, EXTENDED_STEPS)


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def fingerprint(name: Column, masked: Column) -> Column:
    return short_hash(F.concat(name, F.lit("|"), masked))


def template_id(masked: Column) -> Column:
    return F.concat(F.lit("v1:"), short_hash(masked))

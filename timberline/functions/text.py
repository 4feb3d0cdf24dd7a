"""Small text functions: colour codes, level words, tokens, trimming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal escapes and the words that tell a level.
ANSI = "\\x1b\\[[0-9;?]*[ -/]*[@-~]|\\x1b\\][^\\x07\\x1b]*(\\x07|\\x1b\\\\)"
ERROR_WORDS = (
    r"(?i:\b(\w*errors?|\w*exceptions?|fatal|panic(ked|king)?|traceback|fail|failed|failing|failure"
    r"|cannot|can't|could ?not|couldn't|unable to|not found|no such)\b)|\bE[A-Z_]{3,}\b"
)
ERROR_MARKS = "[✗×✘]"
WARN_WORDS = r"(?i)\b(warn|warning|deprecated|deprecation)\b"
DEBUG_WORDS = r"(?i)\b(debug|trace)\b"
MAX_TOKEN_BYTES = 40


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def trim_all(text: Column) -> Column:
    """Unicode white space off both ends; Spark's trim takes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sniff_level(text: Column) -> Column:
    """error, warn, debug, or null where no word tells."""
    is_error = text.rlike(f"(?U){ERROR_WORDS}") | text.rlike(ERROR_MARKS)
    return F.when(is_error, "error").when(text.rlike(f"(?U){WARN_WORDS}"), "warn").when(text.rlike(f"(?U){DEBUG_WORDS}"), "debug")


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def full_text(attributes: Column | None = None) -> Column:
    """What a text query sees: the text fields and the scalar attributes."""
    names = ["message", "route", "user_id", "request_id", "error_message"]
    out = F.concat_ws(" ", *(F.coalesce(F.col(n), F.lit("")) for n in names))
    attributes = F.col("attributes") if attributes is None else attributes
    pairs = F.from_json(attributes, "map<string,string>")
    scalar = F.map_filter(pairs, lambda k, v: v.isNotNull() & ~v.rlike(r"^[\[{]"))
    said = F.array_join(F.transform(F.map_entries(scalar), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), " ")
    return F.concat(out, F.lit(" "), F.coalesce(said, F.lit("")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

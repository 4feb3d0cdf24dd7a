"""Redaction of personal data and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.mask import unicode

# Patterns with their replacements, applied in this order.
STEPS = [
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CC REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN REDACTED]"),
    (r"AKIA[A-Z0-9]{16}", "[AWS KEY REDACTED]"),
    (r"(?i)(bearer|basic)\s+\S+|(token)\s*[=:]\s*\S+", "$1$2 [REDACTED]"),
    (r"(?i)(key|token|secret|auth|credential|session)\s*[:=]\s*[a-f0-9]{32,}", "$1 [REDACTED]"),
    (r"(?i)(api[_-]?key|apikey|secret[_-]?key|private[_-]?key|access[_-]?key)\s*[:= ]\s*\S+", "$1 [REDACTED]"),
    (r"(?i)(password|passwd|pwd|secret|pass)\s*[:=]\s*\S+", "$1 [REDACTED]"),
    (r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL REDACTED]"),
]


#: Of each pattern: words one of which every match holds, in lower case, without an
#: i, whose dotted capital folds to two characters. None where digits are looked for.
_HOLDS = [(), (), ("ak",), ("bearer", "bas", "token"), ("key", "token", "secret", "auth", "credent", "sess"), ("key",), ("pass", "pwd", "secret"), ("@",)]


def _found(text: Column) -> Column:
    """Whether any pattern matches. A pattern runs only where one of its words is
    there, as plain byte search is far cheaper."""
    # A long s is lower case already, and matches an s.
    folded = F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))
    found = F.lit(False)
    for (pattern, _), words in zip(STEPS, _HOLDS):
        match = text.rlike(unicode(pattern))
        if words:
            held = F.lit(False)
            for word in words:
                held = held | F.contains(folded, F.lit(word))
            match = held & match
        found = found | match
    return found


def redact(text: Column) -> Column:
    """Text with every match replaced. Most rows have none, and aren't taken
    through the chain of replacements."""
    done = text
    for pattern, to in STEPS:
        done = F.regexp_replace(done, F.lit(unicode(pattern)), F.lit(to))
    return F.when(_found(text), done).otherwise(text)


def redact_json(text: Column) -> Column:
    """String values of a JSON text redacted at any depth; keys, numbers and
    other values stay. Each string literal is rewritten on its own."""
    literal = r'"(?:[^"\\]|\\.)*"\s*:?'
    pieces = F.split(F.regexp_replace(text, f"({literal})", "\u0001$1\u0001"), "\u0001")
    is_value = lambda p: p.startswith('"') & p.endswith('"')
    # The last quote is kept out, so that no pattern can eat it.
    inner = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    return F.array_join(F.transform(pieces, lambda p: F.when(is_value(p), F.concat(F.lit('"'), redact(inner(p)), F.lit('"'))).otherwise(p)), "")

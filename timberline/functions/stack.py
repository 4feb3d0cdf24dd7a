"""Frames of stack traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A frame line of each language, tried in this order.
JS_FRAME = r"^\s*at\s+(?:(.+?)\s+\()?([^():\s][^():]*?):(\d+):(\d+)\)?$"
PYTHON_FRAME = r'^\s*File\s+"([^"]+)",\s+line\s+(\d+)(?:,\s+in\s+(.+))?$'
RUST_FRAME = r"^\s*at\s+([^:\s][^:]*?):(\d+):(\d+)$"


def _group(line: Column, pattern: str, k: int) -> Column:
    got = F.regexp_extract(line, pattern, k)
    return F.when(got != "", got)


def frames(stack: Column) -> Column:
    """array<struct<function, file, line, column>> of the lines that are frames."""

    def frame(line: Column) -> Column:
        made = lambda function, file, at, column: F.struct(F.trim(function).alias("function"), file.alias("file"), at.cast("long").alias("line"), column.cast("long").alias("column"))
        none = F.lit(None).cast("string")
        return (
            F.when(line.rlike(JS_FRAME), made(*(_group(line, JS_FRAME, k) for k in (1, 2, 3, 4))))
            .when(line.rlike(PYTHON_FRAME), made(_group(line, PYTHON_FRAME, 3), _group(line, PYTHON_FRAME, 1), _group(line, PYTHON_FRAME, 2), none))
            .when(line.rlike(RUST_FRAME), made(none, _group(line, RUST_FRAME, 1), _group(line, RUST_FRAME, 2), _group(line, RUST_FRAME, 3)))
        )

    return F.filter(F.transform(F.split(stack, r"\r?\n"), frame), lambda f: f.isNotNull())

"""Suggest a pattern with named groups for a sample line of unknown format."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Delimiters in the order in which they are tried, scores, and what
# a part looks like for each field.
DELIMITERS = [" | ", " - ", "\t", " :: ", "::"]
BRACKETED, DELIMITED, FALLBACK, MOST = 0.84, 0.78, 0.25, 0.99
BONUS = {"timestamp": 0.06, "level": 0.05, "message": 0.03}
LOOKS = [
    ("timestamp", re.compile(r"^\d{4}[-/]\d{2}[-/]\d{2}|^\d{2}:\d{2}:\d{2}|^\d{10,13}$")),
    ("level", re.compile(r"^(trace|debug|info|notice|warn|warning|error|critical|fatal)$", re.I)),
    ("method", re.compile(r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$")),
    ("status", re.compile(r"^[1-5]\d{2}$")),
]


def _field(part: str, last: bool, number: int, taken: dict[str, int]) -> str:
    name = next((n for n, look in LOOKS if look.search(part.strip())), None)
    if name is None:
        name = "message" if last else "source" if re.fullmatch(r"[A-Za-z][\w.\-/]*", part.strip()) else f"field_{number}"
    taken[name] = taken.get(name, 0) + 1
    return name if taken[name] == 1 else f"{name}_{taken[name]}"


def _score(base: float, names: list[str]) -> float:
    return round(min(MOST, base + sum(v for n, v in BONUS.items() if n in names)), 2)


def suggest_patterns(sample: str) -> list[tuple[str, float, list[str]]]:
    """(pattern, confidence, fields), the most confident first."""
    line, out = sample.strip("\r\n"), []
    head = re.match(r"^((?:\[[^\]]*\]\s*){2,})(.*)$", line)
    if head:
        groups, taken = re.findall(r"\[([^\]]*)\]", head[1]), {}
        names = [_field(g, False, k + 1, taken) for k, g in enumerate(groups)]
        pattern = r"\s*".join(rf"\[(?P<{n}>[^\]]*)\]" for n in names)
        if head[2]:
            names.append(_field(head[2], True, len(groups) + 1, taken) if not any(look.search(head[2].strip()) for _, look in LOOKS) else "message")
            pattern += rf"\s*(?P<{names[-1]}>.*)"
        out.append((f"^{pattern}$", _score(BRACKETED, names), names))
    for delimiter in DELIMITERS:
        parts = line.split(delimiter)
        if len(parts) >= 3:
            taken = {}
            names = [_field(p, k == len(parts) - 1, k + 1, taken) for k, p in enumerate(parts)]
            pieces = [rf"(?P<{n}>.*{'' if k == len(parts) - 1 else '?'})" for k, n in enumerate(names)]
            out.append((f"^{re.escape(delimiter).join(pieces)}$", _score(DELIMITED, names), names))
            break
    out.append(("^(?P<message>.*)$", FALLBACK, ["message"]))
    return sorted(out, key=lambda x: -x[1])


def learn(samples: DataFrame, key: str, line: str) -> DataFrame:
    """The best suggestion for each sample, in Arrow batches."""
    kind = samples.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [suggest_patterns(x or "")[0] for x in frame["line"]]
            yield pd.DataFrame({"key": frame["key"], "pattern": [b[0] for b in best], "confidence": [b[1] for b in best], "fields": [b[2] for b in best]})

    kept = samples.select(samples[key].alias("key"), samples[line].alias("line"))
    return kept.mapInPandas(run, f"key {kind}, pattern string, confidence double, fields array<string>")

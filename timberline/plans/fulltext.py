"""Full-text queries: a small grammar, predicates, and BM25 ranking.

Bare terms are alternatives; AND, OR, NOT, + and -, parentheses, "phrases",
field:term, field:[a TO b] and ^boost are understood. AND binds tighter than OR, so
``a AND b OR c`` asks for both a and b, or for c. A word that the tokeniser splits
is a phrase. Matching works on token boundaries of the row's text. A field that
log rows don't have is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import full_text, tokens
from timberline.schema import LOG_SCHEMA

K1, B = 1.2, 0.75  # fixed values of the ranking
_LEX = re.compile(r'\s*([+-]?)(?:(\()|(\))(?:\^([\d.]+))?|(?:(\w+):)?(?:"([^"]*)"(?:\^([\d.]+))?|\[(\S+)\s+TO\s+(\S+)\]|([^\s()"\[\]]+)))')
_BOOSTED = re.compile(r"(.*)\^([\d.]+)")


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


def split(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[^\w]+|_", text.lower()) if t)


def parse(query: str):
    """The query as a tree of Bool, Term and Range; ValueError if malformed."""
    lexed, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the query at {query[at:]!r}")
        lexed.append(m.groups())
        at = m.end()
        while at < len(query) and query[at].isspace():
            at += 1
    tree, rest = _clause(lexed)
    if rest:
        raise ValueError("unbalanced parenthesis")
    return tree


def _clause(lexed: list) -> tuple[Bool, list]:
    """Items up to a closing parenthesis. Items that AND joins are a group; groups of
    one item take its sign, others are alternatives."""
    groups: list[list[tuple[str, object]]] = []
    joined, negate = False, False
    while lexed and not lexed[0][2]:
        word, field = lexed[0][9], lexed[0][4]
        if word in ("AND", "OR", "NOT") and not field:
            joined, negate = (joined, True) if word == "NOT" else (word == "AND", negate)
            lexed = lexed[1:]
            continue
        sign = lexed[0][0]
        item, lexed = _item(lexed)
        signed = "-" if sign == "-" or negate else sign, item
        if joined and groups:
            groups[-1].append(signed)
        else:
            groups.append([signed])
        joined, negate = False, False
    signs: dict[str, list] = {"+": [], "": [], "-": []}
    for group in groups:
        sign, item = group[0]
        if len(group) > 1:
            sign, item = "", Bool(tuple(i for s, i in group if s != "-"), (), tuple(i for s, i in group if s == "-"))
        signs[sign].append(item)
    return Bool(tuple(signs["+"]), tuple(signs[""]), tuple(signs["-"])), lexed


def _item(lexed: list) -> tuple[Bool | Term | Range, list]:
    _, opened, _, _, field, phrase, raised, low, high, word = lexed[0]
    rest = lexed[1:]
    if opened:
        inside, rest = _clause(rest)
        if not rest:
            raise ValueError("unbalanced parenthesis")
        return replace(inside, boost=_number(rest[0][3])), rest[1:]
    if field is not None and field not in FIELDS:
        raise ValueError(f"log rows have no field {field!r}")
    if low is not None:
        if not field:
            raise ValueError("a range needs a field")
        return Range(field, low, high), rest
    if phrase is None:
        boosted = _BOOSTED.fullmatch(word)
        phrase, raised = boosted.groups() if boosted else (word, None)
    return Term((phrase,) if field in EXACT else split(phrase), field, _number(raised)), rest


def _number(text: str | None) -> float:
    try:
        return 1.0 if text is None else float(text)
    except ValueError as e:
        raise ValueError(f"not a boost: {text!r}") from e


FIELDS = {*LOG_SCHEMA.fieldNames()}
EXACT = {"level", "source", "log_id", "request_id", "user_id", "route", "method", "parse_format", "status_code", "duration_ms", "timestamp"}


def _has(tokens_text: Column, words: tuple[str, ...]) -> Column:
    return F.contains(tokens_text, F.lit(f" {' '.join(words)} ")) if words else F.lit(False)


def _column(node, text: Column) -> Column:
    if isinstance(node, Term):
        if node.field in EXACT:
            return F.col(node.field).cast("string") == node.words[0]
        if node.field:
            return _has(_token_text(F.col(node.field)), node.words)
        return _has(text, node.words)
    if isinstance(node, Range):
        numeric = node.field in ("status_code", "duration_ms", "timestamp_ms")
        cast = (lambda v: F.lit(float(v))) if numeric else F.lit
        bounds = [F.col(node.field) >= cast(node.low)] if node.low != "*" else []
        bounds += [F.col(node.field) <= cast(node.high)] if node.high != "*" else []
        return reduce(lambda a, b: a & b, bounds, F.col(node.field).isNotNull())
    parts = [_column(n, text) for n in node.must]
    if node.should and not node.must:
        parts.append(reduce(lambda a, b: a | b, [_column(n, text) for n in node.should]))
    parts += [~F.coalesce(_column(n, text), F.lit(False)) for n in node.must_not]
    if not (node.must or node.should):
        return F.lit(False)  # exclusions alone match nothing
    return reduce(lambda a, b: a & b, parts)


def _token_text(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def condition(query: str) -> Column:
    return F.coalesce(_column(parse(query), _token_text(full_text())), F.lit(False))


def terms(node, boost: float = 1.0) -> dict[str, float]:
    """The words that score, with their weights: all but the excluded ones and those
    of exact fields. A word that is asked for twice weighs twice."""
    if isinstance(node, Term):
        return {} if node.field in EXACT else {w: n * boost * node.boost for w, n in Counter(node.words).items()}
    if isinstance(node, Range):
        return {}
    out: dict[str, float] = {}
    for n in (*node.must, *node.should):
        for w, weight in terms(n, boost * node.boost).items():
            out[w] = out.get(w, 0.0) + weight
    return out


def ranked(logs: DataFrame, query: str) -> DataFrame:
    """Matching rows with their BM25 score. The statistics are one aggregation over
    all rows, a single row that is joined to the matches."""
    weights = terms(parse(query))
    words = sorted(weights)
    rows = logs.withColumn("_tokens", tokens(full_text()))
    count = lambda w: F.size(F.filter("_tokens", lambda t: t == w))
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_tokens")).alias("_avg"), *(F.count_if(F.array_contains("_tokens", w)).alias(f"_df{k}") for k, w in enumerate(words)))
    matches = rows.where(condition(query)).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k, w in enumerate(words):
        df, tf = F.col(f"_df{k}"), count(w)
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + weights[w] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_tokens") / F.col("_avg")))
    return matches.withColumn("score", score).drop("_tokens", "_n", "_avg", *(f"_df{k}" for k in range(len(words))))

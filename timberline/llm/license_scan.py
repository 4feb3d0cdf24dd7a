"""Licence scan: Aho-Corasick over identifier tags and notice phrases, and a
shunting-yard parser that evaluates licence expressions.

Texts are lower-cased in A-Z and read as words of digits, letters and bytes from
0x80 on; a phrase matches where its words stand consecutively. One pass of the
automaton over the word string of a text finds every phrase and tag marker.

What follows a tag on its line is read as far as it is an expression: the parser
goes on from token to token, knows identifiers by name, and keeps the longest
part that is whole. Prose, comment marks and punctuation after it end it. The
labels of a tag are the operands that the parser put out, and its verdict is the
value of the postfix form.

Defined cases: a null or empty text has no words and no match; repeated rows are
scanned one by one; very long texts are scanned whole, in one pass; an empty
table gives an empty table; extra columns are kept out of the way, as only the key
and the text are read. A tag without a whole expression has the expression
``''``, no label, and makes the text's verdict null.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.textkit import slices, texts

#: Phrases and labels that the scan always knows.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases of the scan.
NOTICE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_IN_TEXT = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n*]*)", re.I)
#: Identifiers of licences that are permissive, and of others.
PERMISSIVE = frozenset(
    """0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause
    bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0 curl hpnd isc mit mit-0 mulanpsl-2.0 ncsa openssl php-3.01 postgresql psf-2.0
    python-2.0 unicode-dfs-2016 unlicense upl-1.0 w3c wtfpl x11 zlib zpl-2.1""".split()
)
OTHERS = frozenset(
    """agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0
    cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gfdl-1.3-only
    gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
    gpl-3.0-or-later lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
    lgpl-3.0-or-later mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl odbl-1.0 ofl-1.1 osl-3.0 qpl-1.0 sspl-1.0""".split()
)
KNOWN = PERMISSIVE | OTHERS
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|linux-syscall-note")
_OWN = re.compile(r"licenseref-[a-z0-9.-]*[a-z0-9-]")
_MARKS = ".,;:!?\"'`"

_BREAK_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def tokens(said: bytes) -> list[str]:
    """Parentheses and runs between blanks, lower-cased in A-Z."""
    return [t.decode("utf-8", "replace") for t in re.findall(rb"[()]|[^\x09-\x0D\x20()]+", said.lower())]


def is_identifier(token: str) -> bool:
    return token.removesuffix("+") in KNOWN or _OWN.fullmatch(token) is not None


def parse(said: bytes) -> tuple[list[str], str]:
    """Shunting-yard: the longest whole licence expression that ``said`` begins
    with, in postfix form and as it stands; empty without one.

    ``with`` binds tighter than ``and``, which binds tighter than ``or``; only a
    single licence takes an exception.
    """
    out: list[str] = []
    stack: list[str] = []
    read: list[str] = []
    whole: tuple[list[str], str] = [], ""
    after, depth = "operator", 0
    for token in tokens(said):
        bare = token.rstrip(_MARKS)
        operand_next = after in ("operator", "with")
        if token == "(" and after == "operator":
            stack.append(token)
            depth += 1
        elif token == ")" and depth and not operand_next:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
            after = "group"
        elif token in ("and", "or") and not operand_next or token == "with" and after == "licence":
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            after = "with" if token == "with" else "operator"
        elif after == "operator" and is_identifier(bare):
            out.append(bare)
            after = "licence"
        elif after == "with" and _EXCEPTION.fullmatch(bare):
            out.append(bare)
            after = "group"
        else:
            break
        read.append(bare)
        if after in ("licence", "group") and not depth:
            whole = out + stack[::-1], " ".join(read)
        if bare != token:
            break
    return whole


def operands(program: list[str]) -> list[str]:
    """The licences of a postfix program; exceptions aren't."""
    values: list[list[str]] = []
    for token in program:
        if token in _PRECEDENCE:
            right, left = values.pop(), values.pop()
            values.append(left if token == "with" else left + right)
        else:
            values.append([token.removesuffix("+")])
    return values[0] if values else []


def evaluate(program: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool | None:
    """Whether the postfix program can be met with allowed licences only."""
    values: list[bool] = []
    for token in program:
        if token in _PRECEDENCE:
            right, left = values.pop(), values.pop()
            values.append(left or right if token == "or" else left and right if token == "and" else left)
        else:
            values.append(token.removesuffix("+") in allowed)
    return values[0] if values else None


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, label, True))
    for phrase, label in NOTICE_PHRASES.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, label, False))
    out.add_word(f" {TAG} ", (len(TAG) + 2, "", False))
    out.make_automaton()
    return out


def scan_text(text: bytes) -> dict:
    """All findings of one text."""
    words = text.translate(_BREAK_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # one character a byte
    base_at, base, labels, spans, tagged = [], set(), set(), [], False
    starts: list[int] = []  # of the words in the line
    for end, (size, label, is_base) in _automaton().iter(line):
        if not label:
            tagged = True
            continue
        starts = starts or list(accumulate((len(w) + 1 for w in words), initial=1))
        at = bisect_left(starts, end - size + 2)
        spans.append((at, label))
        labels.add(label)
        if is_base:
            base_at.append(at)
            base.add(label)
    expressions, verdicts = [], []
    if tagged:
        for m in TAG_IN_TEXT.finditer(text):
            program, said = parse(m[1])
            expressions.append(said)
            verdicts.append(evaluate(program))
            labels.update(operands(program))
    found = len(spans) + 2 * len(expressions)
    return {
        "n_words": len(words),
        "n_base": len(base_at),
        "first_word": min(base_at, default=None),
        "last_word": max(base_at, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 - 0.5**found,
        "expressions": "; ".join(expressions),
        "permissive": None if not verdicts or None in verdicts else all(verdicts),
        "spans": [{"word": a, "label": b} for a, b in sorted(spans)],
    }


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean, spans array<struct<word: long, label: string>>"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key and the findings of its whole text.

    A narrow map: no shuffle, and memory for one slice of texts at a time.
    """
    kept = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan_text(t) for t in texts(batch.column(1))]
            rows = pa.RecordBatch.from_pylist(found, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.columns], names=["doc_id", *rows.schema.names])

    return kept.mapInArrow(scan, f"doc_id {kind}, {_FIELDS}")


_ARROW = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()),
    ("permissive", pa.bool_()), ("spans", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
])


_PHRASE_ROWS = ", ".join(f"('{p}', '{label}', {p in BASE_PHRASES})" for p, label in {**BASE_PHRASES, **NOTICE_PHRASES}.items())
_KNOWN_ROWS = ", ".join(f"('{name}', {name in PERMISSIVE})" for name in sorted(KNOWN))
#: Expressions are read by a machine of states, token by token, and valued by
#: rewriting their text (T and F for each licence) until a single letter is left.
ORACLE_SQL = r"""
WITH RECURSIVE phrases(phrase, label, base) AS (VALUES @@),
known(name, free) AS (VALUES @known),
worded AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS said,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
split AS (SELECT string_split(phrase, ' ') AS parts, label, base FROM phrases),
placed AS (SELECT row_id, words, unnest(range(1, len(words) + 1)) AS k FROM worded),
found AS (SELECT row_id, k - 1 AS place, label, base FROM placed JOIN split ON words[k] = parts[1] AND words[k:k + len(parts) - 1] = parts),
tagged AS (SELECT row_id, regexp_extract_all(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'spdx-license-identifier:[ \t]*([^\r\n*]*)', 1) AS lines FROM worded
  WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' spdx license identifier ')),
tags AS (SELECT row_id, k AS tag, regexp_extract_all(lines[k], '[()]|[^\x09-\x0D\x20()]+') AS t FROM (SELECT row_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM tagged)),
steps AS (
  SELECT row_id, tag, t, 0 AS k, 'operator' AS after, 0 AS depth, false AS over, 0 AS whole, [] :: VARCHAR[] AS roles FROM tags
  UNION ALL
  SELECT row_id, tag, t, k + 1, role, deep, over2, CASE WHEN role IN ('licence', 'exception', 'group') AND deep = 0 THEN k + 1 ELSE whole END, list_append(roles, role)
  FROM (SELECT *, depth + CASE WHEN role = 'open' THEN 1 WHEN role = 'group' THEN -1 ELSE 0 END AS deep, bare <> t[k + 1] AS over2
    FROM (SELECT *, CASE
        WHEN t[k + 1] = '(' AND after IN ('operator', 'open') THEN 'open'
        WHEN t[k + 1] = ')' AND depth > 0 AND after IN ('licence', 'exception', 'group') THEN 'group'
        WHEN t[k + 1] IN ('and', 'or') AND after IN ('licence', 'exception', 'group') THEN 'operator'
        WHEN t[k + 1] = 'with' AND after = 'licence' THEN 'with'
        WHEN after IN ('operator', 'open') AND (regexp_replace(bare, '[+]$', '') IN (SELECT name FROM known) OR regexp_full_match(bare, 'licenseref-[a-z0-9.-]*[a-z0-9-]')) THEN 'licence'
        WHEN after = 'with' AND regexp_full_match(bare, '[a-z0-9.-]*exception[a-z0-9.-]*|linux-syscall-note') THEN 'exception' END AS role
      FROM (SELECT *, rtrim(t[k + 1], '.,;:!?"''`') AS bare FROM steps WHERE NOT over AND k < len(t))))
  WHERE role IS NOT NULL),
read AS (SELECT row_id, tag, list_transform(t[1:whole], lambda x: rtrim(x, '.,;:!?"''`')) AS part, roles[1:whole] AS roles
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id, tag ORDER BY k DESC) AS nth FROM steps) WHERE nth = 1),
named AS (SELECT row_id, tag, i, regexp_replace(part[i], '[+]$', '') AS label FROM (SELECT row_id, tag, part, roles, unnest(range(1, len(part) + 1)) AS i FROM read) WHERE roles[i] = 'licence'),
letters AS (SELECT row_id, tag, i, CASE WHEN label IN (SELECT name FROM known WHERE free) THEN 'T' ELSE 'F' END AS letter FROM named
  UNION ALL SELECT row_id, tag, i, part[i] FROM (SELECT row_id, tag, part, roles, unnest(range(1, len(part) + 1)) AS i FROM read) WHERE roles[i] IN ('open', 'group', 'operator') AND part[i] IN ('(', ')', 'and', 'or')),
worked AS (
  SELECT row_id, tag, '(' || string_agg(letter, ' ' ORDER BY i) || ')' AS formula, 0 AS round FROM letters GROUP BY row_id, tag
  UNION ALL
  SELECT row_id, tag, regexp_replace(regexp_replace(regexp_replace(regexp_replace(formula, 'T and T', 'T', 'g'), 'F and [TF]|T and F', 'F', 'g'), '[(] ?F( or F)* ?[)]', 'F', 'g'), '[(] ?([TF] or )*T( or [TF])* ?[)]', 'T', 'g'), round + 1
  FROM worked WHERE length(formula) > 1),
verdicts AS (SELECT row_id, tag, formula = 'T' AS ok FROM worked WHERE length(formula) = 1),
expressed AS (SELECT row_id, string_agg(array_to_string(part, ' '), '; ' ORDER BY tag) AS expressions, count(*) AS n, CASE WHEN count(ok) = count(*) THEN bool_and(ok) END AS permissive
  FROM read LEFT JOIN verdicts USING (row_id, tag) GROUP BY row_id),
labelled AS (SELECT row_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT row_id, label FROM found UNION ALL SELECT row_id, label FROM named) GROUP BY row_id),
based AS (SELECT row_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM found WHERE base GROUP BY row_id),
weighed AS (SELECT row_id, sum(n) AS n FROM (SELECT row_id, 1 AS n FROM found UNION ALL SELECT row_id, 2 * n FROM expressed) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  1 - pow(0.5, coalesce(w.n, 0)) AS score, coalesce(expressions, '') AS expressions, permissive
FROM worded LEFT JOIN based USING (row_id) LEFT JOIN labelled USING (row_id) LEFT JOIN expressed USING (row_id) LEFT JOIN weighed w USING (row_id)
""".replace("@@", _PHRASE_ROWS).replace("@known", _KNOWN_ROWS)

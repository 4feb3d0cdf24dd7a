from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timberline.functions import mask, redact, stack, text, time


def apply(spark, make, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


def test_template_masks_in_order(spark):
    got = apply(spark, mask.template, ["id 550e8400-e29b-41d4-a716-446655440000 at 10.0.0.1:80", "Timeout to db-3.internal after 1500ms", "user 'bob' deadbeef99 sha256", None])
    assert got == ["id <uuid> at <ip>", "Timeout to db-<num>.internal after <num>ms", "user <str> <hex> sha256", None]


def test_extended_mask_is_idempotent(spark):
    lines = ["GET /api/v1/users 12 in 1.5s", "2026-07-20T03:58:04.581Z a.b.example.com said \"x\"", "ratio 20/20"]
    once = apply(spark, mask.extended, lines)
    assert once == ["GET <path> <num> in <dur>", "<ts> <host> said <str>", "ratio <num>/<num>"]
    assert apply(spark, mask.extended, once) == once


def test_unicode_digits_are_digits(spark):
    assert apply(spark, mask.template, ["٣٤ things", "é9"]) == ["<num> things", "é9"]


def test_redaction(spark):
    got = apply(spark, redact.redact, ["card 4111-1111-1111-1111", "ssn 123-45-6789", "Authorization: Bearer abc.def", "password=hunter2 x", "mail a.b+c@example.co.uk", "api_key: zzz", "plain"])
    assert got == ["card [CC REDACTED]", "ssn [SSN REDACTED]", "Authorization: Bearer [REDACTED]", "password [REDACTED] x", "mail [EMAIL REDACTED]", "api_key [REDACTED]", "plain"]


def test_json_redaction_keeps_keys(spark):
    got = apply(spark, redact.redact_json, ['{"a@b.com":"a@b.com","n":1,"l":["x","password=1"],"o":{"e":"q \\" a@b.com"}}'])
    assert got == ['{"a@b.com":"[EMAIL REDACTED]","n":1,"l":["x","password [REDACTED]"],"o":{"e":"q \\" [EMAIL REDACTED]"}}']


def test_levels_are_sniffed(spark):
    lines = ["TypeError: x", "ENOENT", "ESLint ok", "deprecated call", "trace on", "cannot find", "✗ 1 test", "all fine"]
    assert apply(spark, text.sniff_level, lines) == ["error", "error", None, "warn", "debug", "error", "error", None]


def test_times(spark):
    got = apply(spark, time.normalize, ["2024-03-25 10:00:00,123", "2024-03-25T10:00:00+02:00", "2024-03-25T10:00:00.5Z", "2024-03-25", "junk"])
    assert got == ["2024-03-25T10:00:00.123Z", "2024-03-25T08:00:00.000Z", "2024-03-25T10:00:00.500Z", "2024-03-25", "junk"]
    assert time.parse_duration("2 Days").days == 2 and time.parse_duration("1M").seconds == 60
    for bad in ("", "5", "h", "5y", "-1h"):
        with pytest.raises(ValueError):
            time.parse_duration(bad)
    with pytest.raises(ValueError):
        time.parse_instant("2024-01-01")


def test_stack_frames(spark):
    trace = 'E\n  at f (src/a.ts:47:3)\n  File "/x.py", line 9, in g\n  at src/m.rs:1:2'
    got = apply(spark, stack.frames, [trace])[0]
    assert [(f.function, f.file, f.line) for f in got] == [("f", "src/a.ts", 47), ("g", "/x.py", 9), (None, "src/m.rs", 1)]


def test_redaction_equals_the_whole_chain(spark):
    words = ["toKen=abc1", "paſs: x", "basİc abcd", "sesſion=" + "a" * 32, "API-\u212aEY q", "me@x.io", "AKIA" + "B" * 16, "4111 1111 1111 1111", "123-45-6789", "plain", ""]
    texts = [f"{a} und {b}" for a in words for b in words]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    chain = F.col("t")
    for pattern, to in redact.STEPS:
        chain = F.regexp_replace(chain, F.lit(mask.unicode(pattern)), F.lit(to))
    assert rows.where(~redact.redact(F.col("t")).eqNullSafe(chain)).count() == 0


def test_queries_group_by_and_before_or():
    from timberline.plans.fulltext import Bool, Term, parse, terms

    a, b, c = (Term((x,)) for x in "abc")
    assert parse("a AND b OR c") == Bool(should=(Bool(must=(a, b)), c)) and parse("a OR b AND c") == Bool(should=(a, Bool(must=(b, c))))
    assert parse("a AND NOT b") == Bool(should=(Bool(must=(a,), must_not=(b,)),)) and parse("+a -b c") == Bool((a,), (c,), (b,))
    assert terms(parse("(a^2 OR b c)^3 -d a")) == {"a": 7.0, "b": 3.0, "c": 3.0}
    for bad in ("nofield:x", "(a", "a)", '"open', "[1 TO 2]"):
        with pytest.raises(ValueError):
            parse(bad)

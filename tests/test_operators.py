from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import drain, upsert
from timberline.operators.coalesce import coalesce_blocks
from timberline.operators.ingest import ingest
from timberline.operators.learn import suggest_patterns
from timberline.plans import aggregate, fulltext, search
from timberline.plans.adapters import NOW_MS
from timberline.plans.filters import LogQuery, status_range
from timberline.sources import tail
from timberline.streaming.table import LogTable
from timberline.streaming.watch import watch


def lines_of(spark, lines, path="a.log"):
    rows, at = [], 0
    for line in lines:
        rows.append((path, at, line))
        at += len(line.encode()) + 1
    return spark.createDataFrame(rows, "path string, byte long, line string")


def ingested(spark, lines, path="app.log", now=NOW_MS):
    return ingest(lines_of(spark, lines, path), F.lit(now).cast("long"))


def entry(second, level="info", **more):
    return json.dumps({"timestamp": f"2024-01-30T00:{second // 60:02d}:{second % 60:02d}Z", "level": level, **more})


def test_blocks(spark):
    lines = ["TypeError: x", "  at f (a.js:1:2)", "Caused by: y", "", "   lone", "next", "  error • labelled", *["  more"] * 101]
    got = [(r.byte, r.text) for r in coalesce_blocks(lines_of(spark, lines)).orderBy("byte").collect()]
    assert got[0][1].split("\n") == lines[:3] and got[1][1] == "   lone" and got[2][1] == "next"
    assert [len(t.split("\n")) for _, t in got[3:]] == [64, 38]


def test_block_byte_cap(spark):
    got = coalesce_blocks(lines_of(spark, ["x", *[" " + "y" * 4000] * 3])).orderBy("byte").collect()
    assert [len(r.text) for r in got] == [1 + 2 * 4002, 4001]


def test_blocks_do_not_depend_on_stretches(spark):
    rng = random.Random(8)
    kinds = ["top", "  more", "  more", "", "Caused by: z", "   ", "  error: labelled", "\x1b[31m  red"]
    files = {f"f{k}.log": [rng.choice(kinds) for _ in range(300)] for k in range(3)}
    files |= {"long.log": ["  head", "top", *["  more"] * 400], "blank.log": ["", " ", ""], "above.log": ["  only"] * 150, "after.log": ["top", *[""] * 40, *["  lone"] * 90]}

    def expected(lines):  # one line after another
        out, at, size = [], 0, 0
        fresh = True
        for line in lines:
            n, plain = len(line.encode()), line.replace("\x1b[31m", "")
            if not line.strip():
                fresh = True
            elif not fresh and ((plain[0] == " " and "labelled" not in plain) or plain.startswith("Caused by")) and len(out[-1][1]) < 64 and size + n <= 8192:
                out[-1][1].append(line)
                size += 1 + n
            else:
                out.append((at, [line]))
                size, fresh = n, False
            at += n + 1
        return [(at, "\n".join(said)) for at, said in out]

    every = None
    for path, lines in files.items():
        rows = lines_of(spark, lines, path)
        every = rows if every is None else every.unionByName(rows)
    every = spark.createDataFrame(every.collect(), every.schema)
    want = sorted((p, *x) for p, lines in files.items() for x in expected(lines))
    for stretch in (1, 40, 333, 1 << 24):
        assert sorted(map(tuple, coalesce_blocks(every, stretch).collect())) == want, stretch


def test_formats_and_levels(spark):
    lines = [entry(0, msg="a", userId=7, statusCode="503", odd={"b": 1}), 'time=2024-01-30T00:00:01Z level=warn msg="b c" service=s', "plain text failed", "2024/03/25 10:00:00 WARNING a.go:3: m"]
    rows = {r.parse_format: r for r in ingested(spark, lines).collect()}
    assert set(rows) == {"json", "logfmt", "raw"} or set(rows) == {"json", "logfmt", "raw", "go-logrus"}
    assert (rows["json"].user_id, rows["json"].status_code, rows["json"].attributes) == ("7", 503, '{"odd":{"b":1}}')
    assert (rows["logfmt"].message, rows["logfmt"].level, rows["logfmt"].attributes) == ("b c", "warn", '{"service":"s"}')
    assert rows["raw"].timestamp == "2024-01-31T00:00:00.000Z"


def test_equal_raw_lines_stay_apart_and_again_are_equal(spark):
    first, second = ingested(spark, ["same", "same", "same"]), ingested(spark, ["same", "same", "same"])
    assert first.select("log_id").distinct().count() == 3
    assert upsert.merge(first, second).count() == 3


def test_error_groups(spark):
    lines = [entry(k, "error", message="m", user_id=f"u{k}", error={"name": "DatabaseError", "message": f"timeout after {k}ms"}) for k in range(3)]
    lines += [entry(10 + k, "error", message="m", user_id="u9", error={"name": "AuthError", "message": "no"}) for k in range(2)] + [entry(20, "error", message="alone 5")]
    got = aggregate.error_groups(ingested(spark, lines)).collect()
    assert [(r.name, r["count"], r.affected_users, len(r.samples)) for r in got] == [("DatabaseError", 3, 3, 3), ("AuthError", 2, 1, 2), ("Unknown", 1, 0, 1)]
    assert got[0].template == "timeout after <num>ms"


def test_filters(spark):
    assert status_range("500-599") == (500, 599)
    for bad in ("599-500", "x", "5-"):
        with pytest.raises(ValueError):
            status_range(bad)
    logs = ingested(spark, [entry(0, message="a", duration_ms=5), entry(1, "error", message="pi_9X7abc failed", duration_ms=2000, status=503)])
    assert search.search(logs, LogQuery(NOW_MS, status="500-599")).count() == 1
    assert search.search(logs, LogQuery(NOW_MS, slow_above=1000)).count() == 1
    assert search.search(logs, LogQuery(NOW_MS, query="pi_9X7abc")).count() == 1
    assert search.search(logs, LogQuery(NOW_MS, query='failed -"pi 9x7abc"')).count() == 0
    with pytest.raises(ValueError):
        search.search(logs, LogQuery(NOW_MS), by_relevance=True)
    with pytest.raises(ValueError):
        fulltext.parse("(a")


def test_context_on_ties(spark):
    logs = ingested(spark, [entry(k // 2, message=f"m{k}") for k in range(8)])
    target = logs.orderBy("timestamp", "log_id").limit(1)
    got = search.context(logs, target, 2).collect()
    assert sorted(r.side for r in got) == ["after", "after", "before"]


def test_context_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"{k:04d}", f"t{rng.randrange(12):02d}") for k in range(120)]
    logs = spark.createDataFrame(rows, "log_id string, timestamp string")
    chosen = rng.sample(rows, 15)
    want = []
    for target, at in chosen:
        others = sorted((t, i) for i, t in rows if i != target)
        sides = {"before": [x for x in others if x[0] <= at][::-1][:4], "after": [x for x in others if x[0] >= at][:4]}
        want += [(target, side, k + 1, i, t) for side, near in sides.items() for k, (t, i) in enumerate(near)]
    got = search.context(logs, spark.createDataFrame(chosen, "log_id string, timestamp string"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert search.context(logs, logs.limit(0), 4).count() == 0


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    shapes = ["GET <path> {} in <dur>", "Connection to {} failed", "job {} done {}", "{} {} {} {} {}", "x"]
    return [rng.choice(shapes).replace("{}", "%s") for _ in range(n)]


def test_drain_by_token_count_equals_one_run(spark):
    rng = random.Random(4)
    masked = [s % tuple(rng.choice(["a", "b", "c9", "dd"]) for _ in range(s.count("%s"))) for s in corpus()]
    rows = [(m, f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}.000Z", f"id{k:04d}", "info", m) for k, m in enumerate(masked)]
    serial = sorted((" ".join(c.template), c.count, c.samples) for c in drain.mine_serially(iter(rows)))
    logs = spark.createDataFrame([(t, k, i, lv, m) for k, (m, t, i, lv, _) in enumerate(rows)], "timestamp string, ingest_seq long, log_id string, level string, message string")
    got = sorted((r.template, r["count"], r.samples) for r in drain.patterns(logs, limit=None).collect())
    assert got == serial and sum(c for _, c, _ in serial) == len(rows)


def test_drain_follows_repetitions_that_go_to_a_template_grown_wider(spark):
    # The second opens a template of its own; once the first is "x y <*> <*> <*> <*>", it goes there.
    said = ["x y a b c d", "x y e f g h", "x y e f g h", "x y a b g h", "x y e b p q", "x y a f p q", "x y e f g h", "x y a b c d"]
    rng = random.Random(6)
    said += [" ".join(rng.choice("abcd") for _ in range(rng.choice([5, 6]))) for _ in range(700)] * 2
    rows = [(m, f"2024-01-01T00:00:{k // 100:02d}.000Z", f"id{k:04d}", rng.choice(["info", "warn"]), m) for k, m in enumerate(said)]
    tell = lambda c: (" ".join(c.template), c.count, c.first_seen, c.last_seen, c.example, c.samples, sorted(c.levels.items()))
    serial = sorted(map(tell, drain.mine_serially(iter(rows))))
    logs = spark.createDataFrame([(t, k, i, lv, m) for k, (m, t, i, lv, _) in enumerate(rows)], "timestamp string, ingest_seq long, log_id string, level string, message string").repartition(5)
    got = sorted((r.template, r["count"], r.first_seen, r.last_seen, r.example, r.samples, sorted(r.levels.items())) for r in drain.patterns(logs, None, None).collect())
    assert got == serial and sum(r[1] for r in got) == len(rows)


def test_learn():
    assert suggest_patterns("[2024-03-25 10:00:00] [INFO] started")[0][2] == ["timestamp", "level", "message"]
    assert suggest_patterns("2024-03-25 10:00:00 | ERROR | it broke here")[0][1] == 0.92
    assert suggest_patterns("free text")[0] == ("^(?P<message>.*)$", 0.25, ["message"])


def test_tail_ranges_cover_each_line_once(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes("".join(f"line {k} é\n" for k in range(500)).encode() + b"\xff open")
    whole = list(tail.read_range(tail.FileRange(str(path), 0, path.stat().st_size, False)))
    for each in (1, 7, 64, 1000):
        parts = [x for r in tail.ranges(str(path), 0, path.stat().st_size, each) for x in tail.read_range(r)]
        assert parts == whole


def test_growing_small_file_is_not_rotated(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\n")
    size, head = 4, tail.head_hash(str(path), 4)
    path.write_bytes(b"one\ntwo\n")
    assert not tail.rotated(str(path), size, head)
    path.write_bytes(b"new\ntwo\n")
    assert tail.rotated(str(path), size, head)


def test_stream_appends_and_rotation(spark, tmp_path):
    path, log = tmp_path / "app.log", LogTable(spark, str(tmp_path / "t"))
    go = lambda: watch(spark, str(path), log, str(tmp_path / "c"), NOW_MS, once=True).awaitTermination()
    path.write_text(entry(0, message="a") + "\n" + entry(1, message="b") + "\n")
    go()
    assert log.read().count() == 2
    path.write_text(path.read_text() + entry(2, message="c") + "\n")
    go()
    assert log.read().count() == 3
    path.write_text(entry(3, message="d") + "\n")
    go()
    assert log.read().count() == 4 and log.status()["documents"] == 4
    assert log.clean(1, NOW_MS + 86_400_000, dry_run=True) == 4 and log.read().count() == 4
    assert log.clean(1, NOW_MS + 86_400_000) == 4 and log.read().count() == 0

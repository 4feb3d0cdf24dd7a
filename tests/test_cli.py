from __future__ import annotations

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from timberline import cli
from timberline.operators import drain
from timberline.plans import alert
from timberline.plans.adapters import NOW_MS
from timberline.project import Project, disk_status
from timberline.sources import tail
from timberline.streaming import table
from timberline.streaming.tap import OpenEvent


def entry(second, level="info", **more):
    return json.dumps({"timestamp": f"2024-01-30T23:{second // 60:02d}:{second % 60:02d}Z", "level": level, **more})


class Shell:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)

    def __call__(self, *argv, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main(list(argv), self.spark, self.root, NOW_MS, out, err, io.StringIO(stdin))
        self.text, self.err = out.getvalue(), err.getvalue()
        return code, [json.loads(line) for line in self.text.splitlines() if line.startswith("{")]


@pytest.fixture
def shell(spark, tmp_path):
    return Shell(spark, tmp_path)


def test_reads_sync_first_and_answer_in_envelopes(shell, tmp_path):
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs" / "Api.log"
    lines = [entry(k, message=f"m{k}", user_id="u1") for k in range(4)] + [entry(9, "error", message="x", error={"name": "DbError", "message": "lost 7"})]
    log.write_text("\n".join(lines) + "\n")
    code, (doc,) = shell("search", "--limit", "2", "--level", "info")
    assert code == 0 and doc["ok"] and doc["sync"]["ingested"] == 5 and list(doc) == sorted(doc)
    assert doc["meta"] | {"time_range": 0} == {"count": 2, "total": 4, "limit": 2, "offset": 0, "filters": {"level": "info"}, "time_range": 0}
    assert [r["message"] for r in doc["data"]["results"]] == ["m3", "m2"] and len(doc["data"]["results"][0]) == 16
    log.write_text(log.read_text() + entry(10, message="later") + "\n")
    code, (doc,) = shell("search", "-q", "later", "--context", "1", "--fields", "message", "--compact")
    assert doc["sync"]["ingested"] == 1
    assert doc["data"]["results"] == [{"target": {"message": "later"}, "before": [{"message": "x"}], "after": []}]
    code, (doc,) = shell("errors")
    assert doc["sync"]["reason"] == "fresh" and doc["data"]["total_errors"] == 1
    assert doc["data"]["groups"][0]["template"] == "lost <num>" and doc["data"]["groups"][0]["error_name"] == "DbError"
    assert shell("stats", "--by-user", "--by-format")[1][0]["data"] == {"total_logs": 6, "by_user": {"u1": 4, "anonymous": 2}, "by_format": {"json": 6}}
    assert [r["message"] for r in shell("search", "--format", "jsonl", "-n", "2")[1]] == ["later", "x"]
    code, (doc,) = shell("patterns")
    assert doc["data"]["scanned"] == 6 and sum(t["count"] for t in doc["data"]["templates"]) == 6
    code, (doc,) = shell("schema")
    assert {f["name"]: f["count"] for f in doc["data"]["schema"]["fields"]}["user_id"] == 4
    code, (doc,) = shell("get", "-U", "u1", "--no-sync")
    assert doc["sync"]["reason"] == "disabled" and doc["meta"]["count"] == 4
    assert shell("search", "-q", "absent")[0] == 2
    code, (doc,) = shell("health")
    assert {c["name"]: c["status"] for c in doc["data"]["checks"]} | {"disk": ""} == {"index": "healthy", "sources": "healthy", "disk": "", "lock": "healthy"}


def test_patterns_are_of_all_rows(shell, tmp_path):
    (tmp_path / "logs").mkdir()
    n = drain.SCAN_ROWS + 10
    (tmp_path / "logs" / "api.log").write_text("".join(entry(k % 3000, message=f"done {k}" if k % 2 else "gone", request_id=f"r{k}") + "\n" for k in range(n)))
    code, (doc,) = shell("patterns")
    got = {t["template"]: (t["count"], t["share_pct"]) for t in doc["data"]["templates"]}
    assert code == 0 and doc["data"]["total_logs"] == doc["data"]["scanned"] == n and "sampled" not in shell.text
    assert got == {"done <num>": (n // 2, 50.0), "gone": (n // 2, 50.0)}


def test_failures_have_codes(shell, tmp_path):
    assert shell("search", "--status", "599-500")[1][0]["error"]["code"] == "usage"
    assert shell("get")[0] == 3 and shell("nonsense")[0] == 3 and shell("search", "--sort", "relevance")[0] == 3
    assert shell("errors", "--last", "soon")[0] == 1
    assert shell("ingest", "absent.log")[0] == 5
    (tmp_path / ".timberline").mkdir(exist_ok=True)
    (tmp_path / ".timberline" / "config.toml").write_text("general = 3 =")
    assert shell("stats")[1][0]["error"]["code"] == "config_invalid"


def test_learn_and_empty(shell):
    code, (doc,) = shell("learn", "--sample", "[2024-03-25 10:00:00] [INFO] started")
    assert code == 0 and doc["data"]["suggestions"][0]["fields"] == ["timestamp", "level", "message"]
    assert shell("stats")[0] == 2
    assert shell("index", "status")[1][0]["data"]["documents"] == 0


def test_ingest_twice_rebuild_and_clean(shell, tmp_path):
    log = tmp_path / "far.log"
    log.write_text("same\nsame\n" + entry(1, message="a") + "\n")
    first, again = (shell("ingest", str(log))[1][0]["data"] for _ in range(2))
    assert (first["entries_indexed"], first["entries_deduplicated"]) == (3, 0)
    assert (again["entries_indexed"], again["entries_deduplicated"]) == (3, 3)
    assert shell("index", "rebuild")[1][0]["data"]["entries_indexed"] == 3
    (tmp_path / ".timberline" / "config.toml").write_text("[general]\nretention_days = 0\n")
    assert shell("index", "clean", "--dry-run")[1][0]["data"]["would_delete"] == 3
    assert shell("index", "clean")[0] == 3
    assert shell("index", "clean", "--force")[1][0]["data"]["deleted"] == 3
    assert shell("index", "status")[1][0]["data"]["documents"] == 0


def test_lock_defers_reads_and_refuses_writers(shell, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(entry(0, message="m") + "\n")
    with Project.load(str(tmp_path)).lock() as held:
        assert held
        code, (doc,) = shell("stats")
        assert doc["sync"]["reason"] == "locked" and doc["notices"][0]["code"] == "sync_deferred"
        assert shell("index", "rebuild")[0] == 4
    assert shell("watch", "--rounds", "1")[1][0]["data"]["ingested"] == 1


def test_tap_passes_through_and_journals(shell, tmp_path):
    said = entry(0, message="a") + "\nTypeError: x\n  at f (a.js:1:2)\n" + entry(1, message="b") + "\n"
    assert shell("tap", "-s", "Dev", stdin=said)[0] == 0
    assert shell.text == said and (tmp_path / ".timberline" / "streams" / "dev.jsonl").read_text() == said
    summary = json.loads(shell.err)["data"]
    assert (summary["lines"], summary["entries_indexed"], summary["indexed_inline"]) == (4, 3, True)
    code, (doc,) = shell("search", "--source", "dev")
    assert doc["sync"]["reason"] == "fresh" and doc["meta"]["total"] == 3
    with Project.load(str(tmp_path)).lock():
        shell("tap", "-s", "dev", stdin="held back\n")
    assert not json.loads(shell.err)["data"]["indexed_inline"]
    assert shell("search", "-q", "held")[1][0]["sync"]["ingested"] == 1


def test_open_event_holds_the_cursor_back():
    o, starts = OpenEvent(), []
    for at, line in enumerate(["a", "  b", "Caused by c", "", "  lone", "error: d", "  error: e"]):
        o.add(line, at)
        starts.append(o.start)
    assert starts == [0, 0, 0, None, 4, 5, 6]


def test_alert_rests_and_fires_for_another(shell, spark, tmp_path):
    state = str(tmp_path / "s" / "alert.json")
    assert alert.due(state, "a", 1000) and not alert.due(state, "a", 1299) and alert.due(state, "b", 1299)
    assert alert.due(state, "b", 1599)
    open(state, "w").write("broken")
    assert alert.due(state, "b", 1600)
    assert alert.within_budget(spark, lambda: [1], 30.0) == [1]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(json.dumps({"timestamp": "2024-01-30T23:55:00Z", "level": "error", "message": "lost 5"}) + "\n")
    shell("stats")
    got = alert.alert(spark, Project.load(str(tmp_path)).table(spark).read(), str(tmp_path / "t.json"), NOW_MS, 60.0)
    assert (got["template"], got["count"]) == ("lost <num>", 1)


def test_disk_limits():
    assert [disk_status(x) for x in (499, 500, 1023, 1024)] == ["unhealthy", "degraded", "degraded", "healthy"]


def test_merges_meet_in_the_identity_s_partition(spark, tmp_path, monkeypatch):
    from timberline.operators.ingest import ingest

    def rows(lines, now):
        return ingest(spark.createDataFrame([("a.log", k, x) for k, x in enumerate(lines)], "path string, byte long, line string"), F.lit(now).cast("long"))

    log = table.LogTable(spark, str(tmp_path / "t"))
    lines = [entry(0, message="own"), "raw line", "2024-01-29 a raw one"]
    assert log.merge(rows(lines, NOW_MS)) == {"rows": 3, "entries_deduplicated": 0}
    # Rows without a time get another one on each reading, and still are the same.
    assert log.merge(rows(lines, NOW_MS + 3 * 86_400_000)) == {"rows": 3, "entries_deduplicated": 3}
    assert log.read().count() == 3 and log.read().agg(F.max("timestamp")).first()[0].startswith("2024-02-03")
    monkeypatch.setattr(table, "MANY_PARTS", 2)
    for k in range(3):
        log.merge(rows([entry(20 + k, message="more")], NOW_MS))
    assert len([p for p in log._state()["parts"] if p["key"] == "2024-01-30"]) <= 2 and log.read().count() == 6
    log.vacuum()
    assert log.read().count() == 6


def test_ranges_of_a_growing_file(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one line\nanother " + b"x" * 50 + b"\nopen and growing on\n")
    end = path.read_bytes().index(b" and")
    got = [x for r in tail.ranges(str(path), 0, end, 16) for x in tail.read_range(r)]
    assert [line for _, _, line in got] == ["one line", "another " + "x" * 50, "open"]
    assert os.path.getsize(path) > end


def test_a_stream_holds_the_open_event_and_bounds_its_batches(spark, tmp_path):
    from timberline.streaming.watch import watch

    def until(wanted, seconds=60):
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            query.processAllAvailable()
            got = sorted(r.message for r in log.read().select("message").collect())
            if got == sorted(wanted):
                return
            time.sleep(0.3)
        raise AssertionError((got, wanted))

    path, log = tmp_path / "a.log", table.LogTable(spark, str(tmp_path / "t"))
    path.write_text("TypeError: lost\n  at f (a.js:1:2)\n")
    query = watch(spark, str(path), log, str(tmp_path / "c"), NOW_MS, interval="200 milliseconds", batch_bytes=60, quiet_ms=3_600_000)
    try:
        until([])
        with path.open("a") as f:
            f.write("  at g (b.js:3:4)\nnext\n")
        until(["TypeError: lost\n  at f (a.js:1:2)\n  at g (b.js:3:4)"])
        with path.open("a") as f:
            f.write("".join(f"line {k} of many\n" for k in range(20)) + "\n")
        whole = ["TypeError: lost\n  at f (a.js:1:2)\n  at g (b.js:3:4)", "next", *(f"line {k} of many" for k in range(20))]
        until(whole)
        assert max(p["numInputRows"] for p in map(dict, query.recentProgress)) <= 20  # each line is read a few times in a batch
    finally:
        query.stop()
    with path.open("a") as f:
        f.write("after a restart\n\n")
    query = watch(spark, str(path), log, str(tmp_path / "c"), NOW_MS, interval="200 milliseconds", batch_bytes=60, quiet_ms=3_600_000)
    try:
        until([*whole, "after a restart"])
    finally:
        query.stop()


def test_where_the_open_event_begins(tmp_path):
    path = tmp_path / "a.log"
    for text, begin in (("a\nb\n", 2), ("a\n  b\n", 0), ("a\n\n", 3), ("a\n\n  b\n", 3), ("x\n error: b\n", 2), ("x\nCaused by y\n", 0), ("", 0)):
        path.write_text(text)
        assert tail.open_event(str(path), 0, len(text)) == begin, text

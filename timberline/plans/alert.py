"""The top recent error group after a failed command, told once in a while."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

from timberline.plans import aggregate
from timberline.plans.filters import LogQuery

# What is looked at, how long one fingerprint rests, how long a query may take.
LOOK_BACK, TOP_GROUPS, REST_SECONDS, BUDGET_SECONDS = "15m", 3, 300, 3.0


def recent_groups(logs: DataFrame, now_ms: int) -> DataFrame:
    return aggregate.error_groups(LogQuery(now_ms=now_ms, level="error", last=LOOK_BACK).apply(logs), TOP_GROUPS)


def due(state: str, fingerprint: str, now_s: int) -> bool:
    """Whether to tell of a group now, which is then noted in the file ``state``:
    the one told last rests for a while, any other is told at once. A state that
    can't be read counts as none."""
    try:
        last = json.loads(Path(state).read_text())
        if last["fingerprint"] == fingerprint and max(0, now_s - last["at"]) < REST_SECONDS:
            return False
    except (OSError, ValueError, KeyError, TypeError):
        pass
    os.makedirs(os.path.dirname(os.path.abspath(state)), exist_ok=True)
    Path(state).write_text(json.dumps({"fingerprint": fingerprint, "at": now_s}))
    return True


def within_budget(spark: SparkSession, run: Callable[[], list[Row]], seconds: float = BUDGET_SECONDS) -> list[Row] | None:
    """The result, or null where it takes too long; its jobs are then cancelled."""
    tag = f"alert-{os.getpid()}-{id(run)}"

    def tagged() -> list[Row]:
        spark.addTag(tag)
        return run()

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(tagged).result(seconds)
    except TimeoutError:
        spark.interruptTag(tag)
        return None
    finally:
        pool.shutdown(wait=False)


def alert(spark: SparkSession, logs: DataFrame, state: str, now_ms: int, seconds: float = BUDGET_SECONDS) -> dict | None:
    """What to tell: the top group of the last minutes; ``{"unknown": true}`` where
    the query ran out of time; null where there is nothing, or nothing new."""
    found = within_budget(spark, lambda: recent_groups(logs, now_ms).collect(), seconds)
    if found is None:
        return {"unknown": True, "window": LOOK_BACK} if due(state, "", now_ms // 1000) else None
    if not found or not due(state, found[0]["fingerprint"], now_ms // 1000):
        return None
    top = found[0]
    return {"window": LOOK_BACK, "fingerprint": top["fingerprint"], "template": top["template"], "count": top["count"], "last_seen": top["last_seen"]}

"""A table of log rows in a folder: merged by identity, partitioned by it as well.

A row's partition follows from what its id is made of: the day, where the row has a
time of its own, else a bucket of the id, which is then salted with the position.
Equal ids thus meet in one partition, and a merge looks at the batch's partitions
alone, however large the table is. It writes the parts that hold an id of the batch
again, and folds small parts together where a partition has many. Readers see the
version that is named last, so they never wait and never see half a merge. One
stream writes a table at a time.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import ids
from timberline.operators import upsert
from timberline.schema import LOG_SCHEMA, SCHEMA_VERSION

#: A partition with so many parts has those of fewer rows than SMALL_ROWS folded.
MANY_PARTS, SMALL_ROWS = 16, 1_000_000
_KEYED = T.StructType([*LOG_SCHEMA.fields, T.StructField("_key", T.StringType())])


def partition_key(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_key``, a function of the identity."""
    own = ids.log_id(*(F.col(n) for n in ("timestamp", "level", "source", "message", "request_id"))) == F.col("log_id")
    day = F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("timestamp", 1, 10)).otherwise("odd")
    return rows.withColumn("_key", F.when(own, day).otherwise(F.concat(F.lit("at-"), F.substring("log_id", 1, 2))))


class LogTable:
    """``path`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------- versions
    def _state(self) -> dict:
        try:
            with open(f"{self.path}/current.json") as f:
                state = json.load(f)
        except (OSError, ValueError):
            return {"schema_version": SCHEMA_VERSION, "parts": []}
        if state.get("schema_version") != SCHEMA_VERSION:
            return {"schema_version": SCHEMA_VERSION, "parts": []}  # rebuilt from the sources
        return state

    def outdated(self) -> bool:
        """Whether there is a table of another schema version, to be rebuilt."""
        try:
            with open(f"{self.path}/current.json") as f:
                return json.load(f).get("schema_version") != SCHEMA_VERSION
        except (OSError, ValueError):
            return False

    def exists(self) -> bool:
        return os.path.exists(f"{self.path}/current.json")

    def _commit(self, parts: list[dict]) -> None:
        os.makedirs(self.path, exist_ok=True)
        own = f"{self.path}/.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            json.dump({"schema_version": SCHEMA_VERSION, "parts": parts}, f)
        os.replace(own, f"{self.path}/current.json")

    def read(self) -> DataFrame:
        return self._read([p["path"] for p in self._state()["parts"]])

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*(f"{self.path}/{p}" for p in paths))

    def _write(self, rows: DataFrame, folder: str) -> tuple[DataFrame, list[dict]]:
        """Write rows by partition: what was written, and its parts. Rebalancing
        splits a partition that has most of the rows over several tasks."""
        partition_key(rows).hint("rebalance", "_key").write.partitionBy("_key").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(_KEYED).parquet(f"{self.path}/{folder}")
        counts = written.groupBy("_key").count().collect()  # one row per partition of the batch
        return written, [{"path": f"{folder}/_key={r['_key']}", "key": r["_key"], "rows": r["count"]} for r in counts]

    # ---------------------------------------------------------------- merges
    def merge(self, rows: DataFrame) -> dict:
        """Put rows in, the last of equal ids winning; returns the counts."""
        parts = self._state()["parts"]
        folder = f"v-{uuid.uuid4().hex[:12]}"
        written, new = self._write(upsert.latest(rows), f"{folder}/new")
        keys = {p["key"] for p in new}
        near = [p for p in parts if p["key"] in keys]
        again = set()
        if near:
            held = self._read([p["path"] for p in near]).select("log_id", F.input_file_name().alias("f"))
            files = held.join(written.select("log_id"), "log_id", "left_semi").select("f").distinct().collect()  # one row per touched file
            folders = {r["f"].rsplit("/", 1)[0] for r in files}
            again = {p["path"] for p in near if any(f.endswith(f"/{p['path']}") for f in folders)}
        for key in keys:
            small = [p["path"] for p in near if p["key"] == key and p["rows"] < SMALL_ROWS]
            if len(small) >= MANY_PARTS:
                again |= set(small)
        replaced, rest = 0, []
        if again:
            _, rest = self._write(self._read(sorted(again)).join(written.select("log_id"), "log_id", "left_anti"), f"{folder}/rest")
            replaced = sum(p["rows"] for p in near if p["path"] in again) - sum(p["rows"] for p in rest)
        self._commit([p for p in parts if p["path"] not in again] + rest + new)
        return {"rows": sum(p["rows"] for p in new), "entries_deduplicated": replaced}

    def clean(self, retention_days: int, now_ms: int, dry_run: bool = False) -> int:
        """Remove rows of the retention's age; returns how many. One scan counts,
        one write keeps what is left of the parts that lose rows."""
        parts = self._state()["parts"]
        if not parts:
            return 0
        aged = upsert.split_by_age(self._read([p["path"] for p in parts]), retention_days, now_ms)
        counts = aged.where("expired").groupBy(F.regexp_extract(F.input_file_name(), r"(v-[^/]+/[^/]+/_key=[^/]+)/[^/]*$", 1).alias("path")).count()
        lost = {r["path"]: r["count"] for r in counts.collect()}  # one row per part
        if lost and not dry_run:
            partly = [p["path"] for p in parts if 0 < lost.get(p["path"], 0) < p["rows"]]
            rest = []
            if partly:
                kept = upsert.split_by_age(self._read(partly), retention_days, now_ms).where("not coalesce(expired, false)").drop("expired")
                _, rest = self._write(kept, f"v-{uuid.uuid4().hex[:12]}/kept")
            self._commit([p for p in parts if p["path"] not in lost] + rest)
        return sum(lost.values())

    def vacuum(self) -> None:
        """Delete folders that the current version doesn't name."""
        named = {p["path"].split("/")[0] for p in self._state()["parts"]}
        for name in os.listdir(self.path):
            if name.startswith("v-") and name not in named:
                shutil.rmtree(f"{self.path}/{name}")

    def drop(self) -> None:
        shutil.rmtree(self.path, ignore_errors=True)

    def status(self) -> dict:
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.path) for f in names)
        return {"documents": sum(p["rows"] for p in self._state()["parts"]), "size_mb": round(size / 1024**2, 2)}

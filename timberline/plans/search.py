"""Search, point lookups and the rows around a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans import fulltext
from timberline.plans.filters import LogQuery

#: Page sizes.
DEFAULT_LIMIT, MOST = 100, 10_000


def page_size(limit: int) -> int:
    return max(1, min(limit, MOST))


def search(logs: DataFrame, query: LogQuery, limit: int = DEFAULT_LIMIT, offset: int = 0, by_relevance: bool = False) -> DataFrame:
    """A page of matches, newest first, or by score where that is asked for."""
    if by_relevance:
        if query.query is None:
            raise ValueError("ranking by relevance needs a query")
        rest = LogQuery(**{**query.__dict__, "query": None})
        found = fulltext.ranked(logs, query.query).where(rest.condition())
        return found.orderBy(F.desc("score"), F.desc("timestamp"), "log_id").offset(offset).limit(page_size(limit))
    found = query.apply(logs).orderBy(F.desc("timestamp"), "log_id")
    return (found.offset(offset) if offset else found).limit(page_size(limit))


def get(logs: DataFrame, query: LogQuery) -> DataFrame:
    """Rows of exactly one selector, newest first."""
    chosen = [n for n in ("log_id", "request_id", "user_id") if getattr(query, n) is not None]
    if len(chosen) != 1:
        raise ValueError("give exactly one of log_id, request_id, user_id")
    return search(logs, query, MOST)


def context(logs: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows up to, and from, each target in the whole timeline.

    ``targets``: log_id and timestamp of a page (at most 10,000 rows, which bounds
    the broadcast). The targets' times cut the timeline into slots; each row finds
    its slot by binary search, and each task keeps the n + 1 first and last rows of
    a slot before anything is shuffled. These hold all neighbours, and their number
    depends on the page and n alone. They are numbered in order, and each target
    takes the numbers next to its time. Ties may stand on both sides; the target
    stands on none.
    """
    wanted = targets.select(F.col("log_id").alias("target"), F.col("timestamp").alias("at")).where("at is not null").limit(MOST)
    times = wanted.agg(F.array_sort(F.collect_set("at")).alias("_times"))
    rows = logs.select("log_id", "timestamp").where("timestamp is not null")
    slotted = rows.join(F.broadcast(times)).withColumn("slot", _slot(F.col("timestamp"), F.col("_times"))).drop("_times")  # one row
    by_slot = Window.partitionBy("slot")
    ends = [slotted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n + 1).drop("k") for w in (by_slot.orderBy("timestamp", "log_id"), by_slot.orderBy(F.desc("timestamp"), F.desc("log_id")))]
    near = ends[0].unionByName(ends[1]).select("log_id", "timestamp").distinct()
    # Marks stand before and after the rows of a target's time: what they count is
    # the number of the row next to them.
    marks = wanted.select("target", F.lit(None).cast("string").alias("log_id"), F.col("at").alias("timestamp"), F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"))
    line = marks.unionByName(near.select(F.lit(None).cast("string").alias("target"), "log_id", "timestamp", F.lit(1).alias("kind")))
    in_order = Window.orderBy("timestamp", "kind", "log_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("number", F.sum((F.col("kind") == 1).cast("long")).over(in_order))
    before = F.sequence("number", F.col("number") - n, F.lit(-1).cast("long"))
    after = F.sequence(F.col("number") + 1, F.col("number") + 1 + n)
    asked = line.where("kind <> 1").select("target", F.when(F.col("kind") == 2, "before").otherwise("after").alias("side"), F.posexplode(F.when(F.col("kind") == 2, before).otherwise(after)).alias("place", "number"))
    found = asked.join(line.where("kind = 1").select("number", "log_id", "timestamp"), "number").where("log_id <> target")
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("target", "side").orderBy("place")))
    return ranked.where(F.col("position") <= n).select("target", "side", "position", "log_id", "timestamp")


def _slot(at: Column, times: Column) -> Column:
    """2 i + 1 for the i-th of the sorted times itself, 2 i for what is before it."""
    steps = F.sequence(F.lit(1), F.lit(MOST.bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.size(times).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(times, middle) < at
        moved = F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))
        return F.when(s["low"] < s["high"], moved).otherwise(s)

    place = F.aggregate(steps, start, halve)["low"]
    return place * 2 + F.coalesce((F.get(times, place) == at).cast("int"), F.lit(0))

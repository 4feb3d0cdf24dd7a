"""Lines to events: a continuation line belongs to the event above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import strip_ansi, trim_all

#: An event holds at most so many lines and bytes.
MAX_LINES, MAX_BYTES = 64, 8192
#: Lines are dealt to tasks by path and stretch of so many bytes.
STRETCH_BYTES = 16 << 20
DIAGNOSTIC = r"(?i)^(error|warning|info|hint)\s*[•:\-]"


def is_continuation(line: Column) -> Column:
    """Indented, unless it is a labelled diagnostic; or a cause."""
    seen = strip_ansi(line)
    indented = seen.rlike(r"^[ \t]") & ~trim_all(seen).rlike(DIAGNOSTIC)
    return indented | seen.startswith("Caused by")


def _runs(lines: DataFrame, stretch_bytes: int) -> DataFrame:
    """path, run, rows: the lines between two breaks, in order; none may be left.

    A blank line, or one that continues nothing, is a break: what follows doesn't
    depend on what stands above it. So each stretch of a file is cut by itself. The
    lines above its first break join the last run of the stretches before it, which
    one row per stretch tells; only those few lines move again.
    """
    stretch = F.floor(F.col("byte") / stretch_bytes)
    marked = lines.select("path", "byte", "line", stretch.alias("stretch"), (trim_all(F.col("line")) == "").alias("blank"))
    marked = marked.withColumn("cut", F.when(F.col("blank") | ~is_continuation(F.col("line")), F.col("byte")))
    placed = marked.withColumn("run", F.max("cut").over(Window.partitionBy("path", "stretch").orderBy("byte")))
    row = F.struct("byte", F.octet_length("line").alias("size"), "line")
    rows = F.array_sort(F.collect_list(F.when(~F.col("blank"), row))).alias("rows")
    own = placed.where("run is not null").groupBy("path", "stretch", "run").agg(rows)

    # Lines above all breaks of their file are a run of their own, numbered -1.
    last = marked.groupBy("path", "stretch").agg(F.max("cut").alias("last"))
    before = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    homes = last.select("path", "stretch", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("home"))
    above = placed.where("run is null").join(homes, ["path", "stretch"]).groupBy("path", "home").agg(rows)
    alone = above.where("home < 0").select("path", F.col("home").alias("run"), "rows")
    more = above.where("home >= 0").select(F.col("path").alias("p"), F.floor(F.col("home") / stretch_bytes).alias("s"), "home", F.col("rows").alias("more"))
    met = own.join(more, (F.col("path") == F.col("p")) & (F.col("stretch") == F.col("s")), "left")
    joined = F.when(F.col("run") == F.col("home"), F.concat("rows", "more")).otherwise(F.col("rows"))
    return met.select("path", "run", joined.alias("rows")).unionByName(alone)


def coalesce_blocks(lines: DataFrame, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """``lines``: path, byte, line. Returns path, byte (of the first line), text.

    Blank lines end an event and are dropped. Runs of lines between breaks are
    cut greedily at the caps by a fold over each run. The work spreads over the
    stretches of each file, so one file may hold most of the lines.
    """
    gathered = _runs(lines, stretch_bytes).where(F.size("rows") > 0)
    one = lambda x: F.struct(x["byte"].alias("byte"), x["line"].alias("text"), F.lit(1).alias("n"), x["size"].alias("size"))
    kind = "array<struct<byte:bigint,text:string,n:int,size:int>>"

    def add(blocks: Column, x: Column) -> Column:
        last = F.element_at(blocks, -1)
        full = (F.size(blocks) == 0) | (last["n"] >= MAX_LINES) | (last["size"] + x["size"] > MAX_BYTES)
        grown = F.struct(last["byte"].alias("byte"), F.concat(last["text"], F.lit("\n"), x["line"]).alias("text"), (last["n"] + 1).alias("n"), (last["size"] + 1 + x["size"]).alias("size"))
        return F.when(full, F.concat(blocks, F.array(one(x)))).otherwise(F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(grown)))

    blocks = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.array(one(F.element_at("rows", 1))).cast(kind), lambda a, x: add(a, x).cast(kind))
    return gathered.select("path", F.explode(blocks).alias("b")).select("path", "b.byte", "b.text")


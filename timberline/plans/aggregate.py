"""Counts, error groups, index statistics, field profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import mask

#: What a null counts as, by dimension.
NULL_NAMES = {"level": "", "route": "unknown", "user_id": "anonymous", "parse_format": "raw"}
PROFILE_ROWS, PROFILE_DISTINCT = 10_000, 1000


def stats(logs: DataFrame, dimension: str) -> DataFrame:
    """Rows by value of a dimension."""
    value = F.coalesce(F.col(dimension), F.lit(NULL_NAMES[dimension]))
    return logs.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def stats_of(logs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Several dimensions from one scan: each row gives one pair per dimension,
    which is counted before it is shuffled."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit(NULL_NAMES[d])).alias("value")) for d in dimensions))
    return logs.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("count"))


def keyed_errors(logs: DataFrame) -> DataFrame:
    """Error rows with name, template and fingerprint."""
    has_error = F.col("error_name").isNotNull() | F.col("error_message").isNotNull()
    name = F.when(has_error, F.coalesce("error_name", F.lit("Unknown"))).otherwise("Unknown")
    said = F.when(has_error, F.coalesce("error_message", F.lit(""))).otherwise(F.col("message"))
    rows = logs.where("level = 'error'").withColumns({"name": name, "said": said})
    rows = rows.withColumn("template", mask.template(F.col("said")))
    return rows.withColumn("fingerprint", mask.fingerprint(F.col("name"), F.col("template")))


def error_groups(logs: DataFrame, limit: int | None = 10, order: Column | None = None) -> DataFrame:
    """Groups of errors by masked message, the largest first. ``order`` tells which
    row was first (by default its time and id). Partial aggregates hold one row, a
    set of users and three ids per group."""
    seq = F.struct("timestamp", "log_id") if order is None else order
    rows = keyed_errors(logs).withColumn("_seq", seq)
    # The three first rows of a group are ranked by a window that Spark limits
    # before the shuffle; the other measures are a plain aggregation.
    first = Window.partitionBy("fingerprint").orderBy("_seq")
    samples = rows.select("fingerprint", "_seq", "log_id").withColumn("k", F.row_number().over(first)).where("k <= 3")
    samples = samples.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("k", "log_id"))).alias("s")).select(F.col("fingerprint").alias("f"), F.col("s.log_id").alias("samples"))
    groups = rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct("user_id").alias("affected_users"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.min_by(F.struct("name", "said", "template"), "_seq").alias("one"),
    )
    groups = groups.select("fingerprint", "count", "affected_users", "first_seen", "last_seen", F.col("one.name").alias("name"), F.col("one.said").alias("message"), F.col("one.template").alias("template"))
    out = groups.join(samples, F.col("fingerprint") == F.col("f")).drop("f")
    if limit is None:
        return out
    return out.orderBy(F.desc("count"), F.desc("last_seen"), F.desc(F.octet_length("template")), "fingerprint").limit(limit)


def index_stats(logs: DataFrame) -> DataFrame:
    """Exact totals over all rows: one row per measure."""
    totals = logs.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    plain = totals.select(F.explode(F.array(
        F.struct(F.lit("total").alias("measure"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("oldest").alias("measure"), F.col("oldest").alias("value")),
        F.struct(F.lit("newest").alias("measure"), F.col("newest").alias("value")),
    )).alias("x")).select("x.measure", "x.value")
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit("")).alias("name")) for c in ("level", "source")))
    counts = logs.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.name").agg(F.count(F.lit(1)).alias("n"))
    return plain.unionByName(counts.select(F.concat("kind", F.lit(":"), "name").alias("measure"), F.col("n").cast("string").alias("value")))


PROFILE_FIELDS = {
    "timestamp": "string", "level": "string", "source": "string", "message": "string", "request_id": "string", "user_id": "string", "route": "string",
    "method": "string", "status_code": "number", "duration_ms": "number", "error_name": "string", "error_message": "string",
    "source_file": "string", "line_number": "number", "parse_format": "string",
}


def profile(logs: DataFrame, newest: int = PROFILE_ROWS) -> DataFrame:
    """Per field of the newest rows: how often it is set, how many values it has
    (``1000+`` at the cap), its first three values and its type. Attributes are
    fields of their own."""
    rows = logs.orderBy(F.desc("timestamp"), "log_id").limit(newest).withColumn("_seq", F.struct("timestamp", "log_id"))
    own = [F.struct(F.lit(n.replace("error_", "error.")).alias("field"), F.lit(kind).alias("type"), F.col(n).cast("string").alias("value")) for n, kind in PROFILE_FIELDS.items()]
    more = F.transform(F.map_entries(F.from_json("attributes", "map<string,string>")), lambda e: F.struct(F.concat(F.lit("attributes."), e["key"]).alias("field"), _json_kind(e["value"]).alias("type"), e["value"].alias("value")))
    cells = rows.select("_seq", F.explode(F.concat(F.array(*own), F.coalesce(more, F.array().cast("array<struct<field:string,type:string,value:string>>")))).alias("c")).select("_seq", "c.*").where("value is not null")
    values = cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.max("_seq").alias("newest"), F.max_by("type", "_seq").alias("type"))
    ranked = values.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("newest"), "value")))
    out = ranked.groupBy("field").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct"), F.max_by("type", "newest").alias("type"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "value")))).alias("s"),
    )
    shown = F.when(F.col("distinct") >= PROFILE_DISTINCT, f"{PROFILE_DISTINCT}+").otherwise(F.col("distinct").cast("string"))
    return out.select("field", "count", shown.alias("distinct_values"), "type", F.col("s.value").alias("samples"))


def _json_kind(value: Column) -> Column:
    return F.when(value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(value.isin("true", "false"), "boolean").when(value.startswith("{"), "object").when(value.startswith("["), "array").otherwise("string")

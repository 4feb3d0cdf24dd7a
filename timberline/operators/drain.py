"""Message patterns by a fixed-depth parse tree, and their DataFrame form.

Messages are split into tokens and routed by their number, then by their first
tokens; in a leaf the most similar template takes the message and replaces what
differs by a wildcard. No state crosses the number of tokens, so each number is
mined by itself, in feed order, and the result equals that of one serial run. Only
the first row of a masked message changes a tree; the others are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import mask, text

# Fixed values of the tree.
DEPTH, SIMILARITY, MAX_CHILDREN, MAX_TOKENS = 4, 0.4, 100, 200
SCAN_ROWS, LINE_CHARS, SAMPLES = 50_000, 1000, 3
ANY = "<*>"


@dataclass
class Cluster:
    template: list[str]
    count: int = 0
    first_seen: str | None = None
    last_seen: str | None = None
    example: str = ""
    samples: list[str] = field(default_factory=list)
    levels: dict[str, int] = field(default_factory=dict)

    def add(self, timestamp: str, log_id: str, level: str, raw: str) -> None:
        if not self.count:
            self.example = raw
        self.count += 1
        if timestamp:
            self.first_seen = min(filter(None, (self.first_seen, timestamp)))
            self.last_seen = max(filter(None, (self.last_seen, timestamp)))
        if len(self.samples) < SAMPLES:
            self.samples.append(log_id)
        self.levels[level] = self.levels.get(level, 0) + 1


class DrainTree:
    def __init__(self) -> None:
        self.roots: dict[int, dict] = {}
        self.clusters: list[Cluster] = []

    def _leaf(self, tokens: list[str]) -> list[Cluster]:
        node = self.roots.setdefault(len(tokens), {})
        for token in tokens[: min(DEPTH - 2, len(tokens))]:
            key = ANY if any(c in "0123456789" for c in token) else token
            if key not in node and key != ANY and len(node) >= MAX_CHILDREN:
                key = ANY
            node = node.setdefault(key, {})
        return node.setdefault(None, [])

    def add(self, masked: str, timestamp: str, log_id: str, level: str, raw: str) -> Cluster:
        tokens = masked.split()[:MAX_TOKENS]
        best, _ = self.place(tokens, self._leaf(tokens))
        best.add(timestamp, log_id, level, raw)
        return best

    def place(self, tokens: list[str], leaf: list[Cluster]) -> tuple[Cluster, bool]:
        """The cluster that takes the tokens, and whether that widened its template."""
        best, best_score = None, -1.0
        for cluster in leaf:
            same = sum(a == b or b == ANY for a, b in zip(tokens, cluster.template))
            score = same / len(tokens) if tokens else 1.0
            if score > best_score:
                best, best_score = cluster, score
        if best is None or best_score < SIMILARITY:
            best = Cluster(list(tokens))
            leaf.append(best)
            self.clusters.append(best)
            return best, False
        was = best.template
        best.template = [b if a == b else ANY for a, b in zip(tokens, was)]
        return best, best.template != was


_SPANS = "masked string, timestamp string, seq long, log_id string, by string, cluster int, template string, n_tokens int"
_AT = "timestamp", "seq", "log_id"


def _feed_order(masked: str = "masked"):
    """The order of the feed: nulls last; the message is told apart where all else is equal."""
    return F.struct(*(F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in (*_AT, masked)))


def _spans(firsts: pd.DataFrame) -> pd.DataFrame:
    """From which row on which cluster takes each masked message. ``firsts``: the first
    row of each. Once in the tree a message fits a template fully, so its repetitions
    change nothing: they go to the foremost template of the leaf that fits, which is
    another one as soon as a template before it has become wide enough."""
    firsts = firsts.sort_values([*_AT, "masked"], kind="stable")
    tree, rows = DrainTree(), []
    numbers: dict[int, int] = {}
    members: dict[int, list[tuple[str, list[str]]]] = {}  # of each cluster
    for masked, *at in firsts[["masked", *_AT]].itertuples(index=False):
        tokens = masked.split()[:MAX_TOKENS]
        leaf = tree._leaf(tokens)
        taken, widened = tree.place(tokens, leaf)
        numbers.setdefault(id(taken), len(numbers))
        members.setdefault(id(taken), []).append((masked, tokens))
        rows.append((masked, *at, masked, taken))
        if widened:
            for later in leaf[next(k for k, c in enumerate(leaf) if c is taken) + 1 :]:
                fit = [all(a == b or b == ANY for a, b in zip(t, taken.template)) for _, t in members[id(later)]]
                if any(fit):
                    moved = [m for m, f in zip(members[id(later)], fit) if f]
                    members[id(later)] = [m for m, f in zip(members[id(later)], fit) if not f]
                    members[id(taken)] += moved
                    rows += [(m, *at, masked, taken) for m, _ in moved]
    told = [(*r[:-1], numbers[id(r[-1])], " ".join(r[-1].template), len(r[-1].template)) for r in rows]
    return pd.DataFrame(told, columns=["masked", *_AT, "by", "cluster", "template", "n_tokens"])


def patterns(logs: DataFrame, scan: int | None = SCAN_ROWS, limit: int | None = 20) -> DataFrame:
    """Mined templates of the newest ``scan`` rows, or of all if it is None, the most
    frequent first, with their share in percent. ``logs`` needs ingest_seq for the
    order of equal times. Trees are grown from the first row of each masked message;
    rows are never gathered."""
    rows = logs.orderBy(F.desc("timestamp"), F.desc("ingest_seq")).limit(scan) if scan else logs
    raw = F.substring(text.first_line(F.col("message")), 1, LINE_CHARS)
    fed = rows.select("timestamp", F.coalesce("ingest_seq", F.lit((1 << 63) - 1)).alias("seq"), "log_id", "level", raw.alias("raw")).withColumn("masked", mask.extended(F.col("raw")))
    count = F.least(F.size(F.filter(F.split("masked", r"(?U)\s+"), lambda t: t != "")), F.lit(MAX_TOKENS))
    firsts = fed.groupBy("masked").agg(F.min(_feed_order()).alias("x")).select("masked", *(F.col(f"x.{c}")[c].alias(c) for c in _AT))
    spans = firsts.groupBy(count.alias("n")).applyInPandas(lambda key, group: _spans(group).assign(n=key[0]), f"{_SPANS}, n int")
    placed = spans.groupBy("masked").agg(F.sort_array(F.collect_list(F.struct(_feed_order("by").alias("at"), "n", "cluster", "template", "n_tokens"))).alias("spans"))
    at = _feed_order()
    of = F.when(F.size("spans") == 1, F.col("spans")[0]).otherwise(F.element_at(F.filter("spans", lambda s: s["at"] <= at), -1))
    tagged = fed.join(placed, "masked").select("*", of.alias("of")).select("of.n", "of.cluster", "of.template", "of.n_tokens", *_AT, "level", "raw", "masked")
    own = ["n", "cluster"]
    seen = F.when(F.col("timestamp") != "", F.col("timestamp"))
    levels = tagged.groupBy(*own, "level").agg(F.count(F.lit(1)).alias("c"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.first("template").alias("template"), F.first("n_tokens").alias("n_tokens"))
    mined = levels.groupBy(*own).agg(F.first("template").alias("template"), F.first("n_tokens").alias("n_tokens"), F.sum("c").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "c")))).alias("levels"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(_feed_order()))
    ahead = tagged.withColumn("place", place).where(F.col("place") <= SAMPLES).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("place", "log_id", "raw"))).alias("x"))
    mined = mined.join(ahead, own).select("template", "n_tokens", "count", "first_seen", "last_seen", F.col("x")[0]["raw"].alias("example"), F.col("x.log_id").alias("samples"), "levels")
    total = fed.agg(F.count(F.lit(1)).alias("total"))
    out = mined.join(F.broadcast(total)).withColumn("share", F.round(F.col("count") * 1000.0 / F.col("total")) / 10).drop("total")  # one row
    out = out.withColumn("template_id", mask.template_id(F.col("template")))
    if limit is None:
        return out
    return out.orderBy(F.desc("count"), F.desc("last_seen"), F.desc("n_tokens"), F.split("template", " ")).limit(limit)


def mine_serially(rows: Iterator[tuple[str, str, str, str, str]]) -> list[Cluster]:
    """One tree over (masked, timestamp, log_id, level, raw) rows, for tests."""
    tree = DrainTree()
    for row in rows:
        tree.add(*row)
    return tree.clusters

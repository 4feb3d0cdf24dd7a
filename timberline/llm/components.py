"""Connected components of a distributed edge table.

In a round every node points to its smallest neighbour, if that is smaller than
itself, and pointers jump until they end at roots: nodes smaller than all their
neighbours, at most half of the nodes. Edges between nodes of one root then go, the
others are those of a graph of roots, each once, for the next round; so a group with
many links inside is joined with its labels once and not in every round. A graph of at
most ``FEW_EDGES`` edges, by count, is one task's. No edge or label reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.scratch import Scratch

FEW_EDGES = 10_000


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a small graph; the smallest node is the label."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = pa.binary()
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    nodes = list(up)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "label"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges``: a written table with columns a, b (of one orderable type, a <> b). Returns node, label: the smallest
    node of the component, for every node that has an edge."""
    kind = edges.schema["a"].dataType.simpleString()
    rounds: list[DataFrame] = []
    while edges.limit(FEW_EDGES + 1).count() > FEW_EDGES:
        own = f"{name}-{len(rounds)}"
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        roots = _roots(scratch.save(least.select("node", F.least("node", "m").alias("label")), f"{own}-up"), scratch, own)
        ends = edges.join(roots.toDF("a", "la"), "a").join(roots.toDF("b", "lb"), "b").where("la <> lb")
        edges = scratch.save(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), f"{own}-ends")
        rounds.append(roots)
    labels = scratch.save(edges.select("a", "b").coalesce(1).mapInArrow(_few, f"node {kind}, label {kind}"), f"{name}-few")
    for k, roots in reversed(list(enumerate(rounds))):
        further = labels.toDF("label", "top")
        labels = scratch.save(roots.join(further, "label", "left").select("node", F.coalesce("top", "label").alias("label")), f"{name}-{k}-labels")
    return labels


def _roots(up: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label with the label's label in place of the label, until none changes."""
    step = 0
    while True:
        step += 1
        target = up.toDF("t", "next")
        moved = scratch.save(up.join(target, up["label"] == target["t"]).select("node", F.col("next").alias("label"), F.col("label").alias("was")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}" if step > 1 else f"{name}-up")
        up = moved.select("node", "label")
        if not moved.where("label <> was").limit(1).count():
            return up

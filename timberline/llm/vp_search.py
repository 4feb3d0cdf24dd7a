"""Nearest neighbours by inner product with vantage-point trees per shard.

Vectors get one more component so that inner products order as distances do
(x -> [x, sqrt(M^2 - |x|^2)], q -> [q M / |q|, 0], M the largest norm: all lie on one
sphere). A vantage-point tree
over a bounded sample of ``SAMPLE`` rows deals all rows into cells; a cell is cut by
a hash where it holds more rows than a shard may, as one of many copies does. For
every cell the least and largest distance to each vantage point above it are taken
over all its rows. Every shard is a vantage-point tree of its own, which is built
once and then meets its queries as a stream, block by block.

A query first visits one shard of its own cell. The k-th nearest there bounds what
other shards may hold: by the triangle inequality, a cell, like a branch of a tree,
is skipped where its distances to a vantage point show all its rows to be farther.
``factor`` scales that bound: 1 is exact search, larger prunes more and may miss
neighbours. In a second round a query visits the shards that are left, with its
bound. A shard that very many queries visit is held by several tasks.

Shards have about ``16 * sqrt(n)`` rows, so that a query is copied to no more
shards than the square root of the rows. What is broadcast (the cells' vantage
points and bounds) has at most ``MOST_CELLS`` rows.

Defined cases: vectors that are null, empty, all zero, or hold a null or
non-finite component take no part, on either side; so do vectors whose length
isn't that of most; a null id takes no part; repeated rows are candidates each,
and a repeated query is asked once; unlike queries of one id are answered each;
ties go to the smaller id; fewer than k candidates give fewer rows; empty
tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.scratch import Scratch

LEAST_ROWS, MOST_ROWS = 1024, 65536  # of a shard
MOST_CELLS = 1024
SAMPLE = 8192  # rows that the cells' vantage points are chosen from
BLOCK_ROWS = 512  # queries that a shard answers at once
STREAM_ROWS = 1 << 18  # queries that one task answers
LEAF_ROWS = 128


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, component by component, so equal vectors score equally."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * query[j]
    return out


def asked_points(queries: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries on the sphere of the rows, and what they were scaled by."""
    by = norm / np.sqrt((queries**2).sum(1))
    return np.concatenate([queries * by[:, None], np.zeros((len(queries), 1))], 1), by


def distance_of(product, by, norm: float):
    """The distance on the sphere that an inner product is."""
    return np.sqrt(np.maximum(2 * norm**2 - 2 * product * by, 0.0))


@dataclass
class Node:
    at: np.ndarray | None = None  # rows of a leaf
    vantage: int = -1
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    near: float = 0.0  # least distance of the outside from the vantage point
    far: float = 0.0  # largest distance of the outside


class VPTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: float):
        self.vectors, self.ids = vectors, ids
        squared = (vectors**2).sum(1)
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(norm**2 - squared, 0))[:, None]], 1)
        self.norm = norm
        self.root = self._build(np.arange(len(ids)))

    def _build(self, at: np.ndarray) -> Node:
        if len(at) <= LEAF_ROWS:
            return Node(at=at)
        vantage = int(at[len(at) // 2])
        distance = np.sqrt(((self.points[at] - self.points[vantage]) ** 2).sum(1))
        radius = float(np.median(distance))
        inside = distance <= radius
        if inside.all():  # equal distances, as among copies
            inside = np.arange(len(at)) < len(at) // 2
        node = Node(vantage=vantage, radius=float(distance[inside].max()))
        node.near, node.far = float(distance[~inside].min()), float(distance[~inside].max())
        node.inside, node.outside = self._build(at[inside]), self._build(at[~inside])
        return node

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score, nth query) of the k best for every query, of those
        whose product is no less than ``least``."""
        n = len(queries)
        self.q = queries
        self.at, self.by = asked_points(queries, self.norm)
        self.qid, self.k = query_ids, k
        self.best = [np.zeros(0, int)] * n
        self.product = [np.zeros(0)] * n
        self.least = np.full(n, -np.inf) if least is None else least.copy()  # the k-th largest product so far
        self.tau = distance_of(self.least, self.by, self.norm)
        self.slack = 2e-6 * self.norm  # of distances, above their rounding
        self._visit(self.root, np.arange(n), factor)
        at = np.concatenate(self.best) if n else np.zeros(0, int)
        nth = np.repeat(np.arange(n), [len(x) for x in self.best])
        return query_ids[nth], self.ids[at], np.concatenate(self.product) if n else np.zeros(0), nth

    def _visit(self, node: Node, active: np.ndarray, factor: float) -> None:
        if not len(active):
            return
        if node.at is not None:
            self._leaf(node.at, active)
            return
        d = np.sqrt(((self.at[active] - self.points[node.vantage]) ** 2).sum(1))
        first = d <= (node.radius + node.near) / 2
        for inside_first in (True, False):
            some, far = active[first == inside_first], d[first == inside_first]
            for inner_branch in (inside_first, not inside_first):
                least = far - node.radius if inner_branch else np.maximum(node.near - far, far - node.far)
                keep = least * factor <= self.tau[some] + self.slack
                self._visit(node.inside if inner_branch else node.outside, some[keep], factor)

    def _leaf(self, at: np.ndarray, active: np.ndarray) -> None:
        rows, asked = self.vectors[at], self.q[active]
        # A fast product, wrong by no more than its rounding, tells what can be among
        # the best; the score of that is summed as inner() does, so ties are exact.
        rounding = 4 * rows.shape[1] * np.finfo(float).eps * self.norm**2 / self.by[active]
        which, column = np.nonzero(asked @ rows.T >= (self.least[active] - rounding)[:, None])
        if not len(which):
            return
        product_of = np.zeros(len(which))
        for j in range(rows.shape[1]):
            product_of += asked[which, j] * rows[column, j]
        products = np.full((len(active), len(at)), -np.inf)
        products[which, column] = product_of
        ids = self.ids[at]
        for row, i in enumerate(active):
            hit = (products[row] >= self.least[i]) & (products[row] > -np.inf) & (ids != self.qid[i])
            if not hit.any():
                continue
            best, product = np.concatenate([self.best[i], at[hit]]), np.concatenate([self.product[i], products[row][hit]])
            order = np.lexsort((self.ids[best], -product))[: self.k]
            best, product = best[order], product[order]
            if len(best) >= self.k:
                self.least[i] = product[-1]
                self.tau[i] = distance_of(product[-1], self.by[i], self.norm)
            self.best[i], self.product[i] = best, product


@dataclass
class Cells:
    """The top of the tree: vantage points and radii by heap order (children of j are
    2 j + 1, inside, and 2 j + 2), ``depth`` levels, and one cell for each way down."""

    vantage: np.ndarray  # points, with the further component
    radius: np.ndarray
    depth: int
    norm: float

    @staticmethod
    def of(sample: np.ndarray, cells: int, norm: float) -> Cells:
        points = further(sample, norm)
        depth = max(0, (cells - 1).bit_length())
        out = Cells(np.zeros((2**depth - 1, points.shape[1])), np.zeros(2**depth - 1), depth, norm)
        held = {0: np.arange(len(points))}
        for j in range(2**depth - 1):
            at = held.pop(j)
            if not len(at):  # copies above left nothing; any point will do
                at = np.arange(min(1, len(points)))
            out.vantage[j] = points[at[len(at) // 2]]
            distance = np.sqrt(((points[at] - out.vantage[j]) ** 2).sum(1))
            out.radius[j] = np.median(distance)
            inside = distance <= out.radius[j]
            held[2 * j + 1], held[2 * j + 2] = at[inside], at[~inside]
        return out

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point, and its distances to the vantage points above."""
        node = np.zeros(len(points), np.int64)
        distance = np.zeros((len(points), self.depth))
        for level in range(self.depth):
            distance[:, level] = np.sqrt(((points - self.vantage[node]) ** 2).sum(1))
            node = 2 * node + np.where(distance[:, level] <= self.radius[node], 1, 2)
        return node - (2**self.depth - 1), distance

    def least_distance(self, points: np.ndarray, bounds: dict[int, np.ndarray]) -> np.ndarray:
        """points x cells: no row of the cell is nearer. ``bounds``: of each cell that
        holds rows, depth x (least, largest) distance to the vantage points above."""
        to = np.sqrt(np.maximum(((points**2).sum(1)[:, None] + (self.vantage**2).sum(1)[None, :] - 2 * points @ self.vantage.T), 0.0))
        out = np.full((len(points), 2**self.depth), np.inf)
        for cell, bound in bounds.items():
            node, low = cell + 2**self.depth - 1, np.zeros(len(points))
            for level in range(self.depth - 1, -1, -1):
                node = (node - 1) // 2
                low = np.maximum(low, np.maximum(bound[level, 0] - to[:, node], to[:, node] - bound[level, 1]))
            out[:, cell] = low
        return out


def further(vectors: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([vectors, np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))[:, None]], 1)


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part; single precision stays as narrow."""
    element = df.schema[vector].dataType.elementType.simpleString()
    v = F.col("v")
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<float>" if element == "float" else "array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite).where(F.exists(v, lambda x: x != 0))
    return rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def _placer(cells: Cells, width: int):
    """id, v, and the cell with the distances to the vantage points above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = cells.place(further(_matrix(batch.column(1), width), cells.norm))
            lists = pa.ListArray.from_arrays(np.arange(0, distance.size + 1, max(1, cells.depth), dtype=np.int32) if cells.depth else np.zeros(len(cell) + 1, np.int32), distance.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), lists], names=["id", "v", "cell", "d"])

    return run


def _router(cells: Cells, width: int, bounds: dict[int, np.ndarray], parts: dict[int, int], factor: float, first: bool):
    """The visits of queries, as shards. In the first round each visits a shard of the
    cell that it lies in or, without rows there, of the nearest one; in the second, all
    others that may hold one of its nearest."""
    known = sorted(bounds)
    begin = np.concatenate([[0], np.cumsum([parts[c] for c in known])])  # shards of the cells, in order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(k, BLOCK_ROWS)
                get = lambda name: some.column(some.schema.get_field_index(name))  # noqa: B023, E731
                q = _matrix(get("v"), width)
                points, by = asked_points(q, cells.norm)
                low = cells.least_distance(points, bounds)[:, known]
                own, _ = cells.place(points)
                home = np.where(np.isin(own, known), np.searchsorted(known, own).clip(0, len(known) - 1), low.argmin(1))
                visited = begin[home] + np.asarray(get("rid")).astype(np.int64) % np.array([parts[known[h]] for h in home.tolist()])
                if first:
                    row, shard = np.arange(len(q)), visited
                else:
                    least = np.asarray(get("least").fill_null(-np.inf))
                    tau = distance_of(least, by, cells.norm) + 2e-6 * cells.norm
                    row, at = np.nonzero(low * factor <= tau[:, None])
                    number = np.diff(begin)[at]
                    row, shard = np.repeat(row, number), np.repeat(begin[at], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                    new = shard != visited[row]
                    row, shard = row[new], shard[new]
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(get(n).take(pa.array(row)) for n in ("rid", "id", "v", "least"))], names=["shard", "rid", "id", "v", "least"])

    return run


def _searcher(width: int, norm: float, k: int, factor: float):
    """Rows sorted by shard and task, vectors before queries: a tree for each shard
    from its vectors, then its queries in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids, tree = None, [], [], None
        held: list[pa.RecordBatch] = []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal tree, held
            if held and ids:
                if tree is None:
                    tree = VPTree(np.concatenate(vectors), np.concatenate(ids), norm)
                table = pa.Table.from_batches(held).combine_chunks()
                q, rid = _matrix(table["v"].combine_chunks(), width), np.asarray(table["rid"])
                least = np.asarray(table["least"].combine_chunks().fill_null(-np.inf))
                found = tree.search(q, np.asarray(table["id"]), k, factor, least)
                yield pa.RecordBatch.from_arrays([pa.array(rid[found[3]]), pa.array(found[0]), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["rid", "query_id", "vec_id", "score"])
            held = []

        for batch in batches:
            shard = np.asarray(batch.column(0)).astype(np.int64) << 33 | np.asarray(batch.column(1)).astype(np.int64) << 1 | ~np.asarray(batch.column(3).is_null())
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j == i:
                    continue
                part = batch.slice(i, j - i)
                if shard[i] >> 1 != now:
                    yield from answers()
                    now, vectors, ids, tree = shard[i] >> 1, [], [], None
                if shard[i] & 1:
                    for b in range(0, len(part), BLOCK_ROWS):
                        held.append(part.slice(b, BLOCK_ROWS))
                        if sum(map(len, held)) >= BLOCK_ROWS:
                            yield from answers()
                else:
                    vectors.append(_matrix(part.column(4), width))
                    ids.append(np.asarray(part.column(2)))
        yield from answers()

    return run


def _visit(shards: DataFrame, visits: DataFrame, scratch: Scratch, name: str, search) -> DataFrame:
    """rid, query_id, vec_id, score of what the visits find. A shard that more than
    ``STREAM_ROWS`` queries visit is dealt to several tasks, with its vectors."""
    visits = scratch.save(visits, f"visits-{name}")
    tasks = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STREAM_ROWS).cast("int").alias("tasks"))
    tasks = scratch.save(tasks, f"tasks-{name}")
    rows = shards.join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select("shard", "task", "id", F.lit(None).cast("long").alias("rid"), "v", F.lit(None).cast("double").alias("least"))
    asked = visits.join(tasks, "shard").withColumn("task", F.pmod("rid", "tasks").cast("int")).select("shard", "task", "id", "rid", "v", "least")
    dealt = rows.unionByName(asked).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("rid").isNotNull())
    return scratch.save(dealt.mapInArrow(search, "rid long, query_id long, vec_id long, score double"), f"found-{name}")


def vp_search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` for each
    row of ``queries``, without the rows that have the query's own id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vp")
    known = scratch.save(clean_vectors(vectors, key, vector), "vectors")
    sizes = known.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, norm = sizes["d"], float(sizes["m"]) ** 0.5
    known = known.where(F.size("v") == width)
    asked = clean_vectors(queries, key, vector).where(F.size("v") == width).distinct()
    asked = scratch.save(asked.withColumn("rid", F.monotonically_increasing_id()), "queries")

    shard_rows = int(min(MOST_ROWS, max(LEAST_ROWS, 16 * sizes["n"] ** 0.5)))
    sample = known.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows at most
    cells = Cells.of(_matrix(sample["v"].combine_chunks(), width), min(MOST_CELLS, -(-sizes["n"] // shard_rows)), norm)
    placed = scratch.save(known.mapInArrow(_placer(cells, width), f"id long, v {known.schema['v'].dataType.simpleString()}, cell int, d array<double>"), "placed")
    edges = [f(F.col("d")[i]).alias(f"{n}{i}") for i in range(cells.depth) for n, f in (("low", F.min), ("high", F.max))]
    rows = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()  # MOST_CELLS rows at most
    bounds = {r["cell"]: np.array([[r[f"low{i}"], r[f"high{i}"]] for i in range(cells.depth)]).reshape(-1, 2) for r in rows}
    parts = {r["cell"]: -(-r["n"] // shard_rows) for r in rows}
    begin = np.cumsum([0, *(parts[c] for c in sorted(parts))]).tolist()
    first_shard = F.create_map(*(F.lit(x) for c, b in zip(sorted(parts), begin) for x in (c, b)))
    number = F.create_map(*(F.lit(x) for c in sorted(parts) for x in (c, parts[c])))
    shards = placed.select((first_shard[F.col("cell")] + F.pmod(F.xxhash64("id", "v"), number[F.col("cell")]).cast("int")).alias("shard"), "id", "v")

    fields = f"shard int, rid long, id long, v {known.schema['v'].dataType.simpleString()}, least double"
    search = _searcher(width, norm, k, factor)
    home = asked.withColumn("least", F.lit(None).cast("double")).mapInArrow(_router(cells, width, bounds, parts, factor, True), fields)
    near = _visit(shards, home, scratch, "near", search)
    kth = near.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("rid", "least")
    left = asked.join(kth, "rid", "left").select("id", "v", "rid", "least")
    others = left.mapInArrow(_router(cells, width, bounds, parts, factor, False), fields)
    found = near.unionByName(_visit(shards, others, scratch, "far", search))
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""

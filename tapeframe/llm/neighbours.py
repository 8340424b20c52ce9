"""Approximate nearest neighbours by stable projections and kd-trees.

A Gaussian projection to ``dims`` dimensions is 2-stable: the squared projected distance of
two vectors over their squared distance follows a chi-square distribution with ``dims``
degrees of freedom.

1. **Classes.** Equal vectors are one class with its ``k + 1`` least ids: no answer needs
   more of them, as ties go to the least id.  They are found in two steps with a salt, so
   a vector with a third of all rows is a few rows a task.
2. **Cells.** A kd-tree over the projections of a bounded sample (``SAMPLE``) cuts the
   projected space into cells of about ``CELL`` classes; larger cells are dealt out in
   parts by hash.  Every class is indexed.
3. **Search.** In each part a kd-tree hands out the projected neighbours of a query from
   near to far, and each is verified on the original vectors.  The search stops once, if
   a nearer vector were left, its projection would have shown up already with probability
   ``sure``: when the chi-square distribution function at (projected distance / k-th
   distance so far) squared reaches ``sure``.
4. **Two passes.** A query first searches its own cell; the k-th distance found there and
   the boxes of the other cells tell by the same test which of these it must search.

Vectors that are null, zero, or hold a null or a non-finite component take no part, nor
those whose length is not the most frequent one (the longer of equals).  Repeated vec_ids
are one id; one with several vectors has the least of them, by their components in order.  With fewer candidates than ``k``, all are returned; empty tables give none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.llm.batches import Shared
from tapeframe.session import cut_lineage

DIMS = 8
SAMPLE = 20_000
CELL = 4096
LEAF = 256
SALT = 32


def chi_square(x: np.ndarray | float, dims: int) -> np.ndarray | float:
    """Distribution function of the chi-square distribution with an even number of degrees of freedom."""
    half = np.asarray(x) / 2
    total, term = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


class Tree:
    """Balanced kd-tree over points, with the box of each node; leaves hold about ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points = points
        self.nodes: list[tuple] = []
        self.build(np.arange(len(points)), leaf)

    def build(self, own: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        low, high = self.points[own].min(axis=0), self.points[own].max(axis=0)
        self.nodes.append(())
        axis = int(np.argmax(high - low))
        if len(own) <= leaf or high[axis] == low[axis]:
            self.nodes[at] = (low, high, own, -1, -1)
        else:
            half = len(own) // 2
            order = own[np.argpartition(self.points[own, axis], half)]
            left, right = self.build(order[:half], leaf), self.build(order[half:], leaf)
            self.nodes[at] = (low, high, None, left, right)
        return at

    def near(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves from near to far: squared distance to the box, and points."""
        heap = [(self.distance(0, query), 0)]
        while heap:
            d, at = heapq.heappop(heap)
            _, _, own, left, right = self.nodes[at]
            if own is not None:
                yield d, own
            else:
                for child in (left, right):
                    heapq.heappush(heap, (self.distance(child, query), child))

    def distance(self, at: int, query: np.ndarray) -> float:
        low, high = self.nodes[at][:2]
        gap = np.maximum(low - query, 0) + np.maximum(query - high, 0)
        return float(gap @ gap)


class Cells:
    """Cuts of the projected space: the cell of a point is the path of its comparisons."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.axis, self.cut = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        groups = {1: sample}
        for node in range(1, 1 << depth):
            own = groups.pop(node)
            axis = int(np.argmax(own.var(axis=0))) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            groups[2 * node], groups[2 * node + 1] = own[own[:, axis] < cut], own[own[:, axis] >= cut]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)


def classes(vectors: DataFrame, keep: int, every: int) -> DataFrame:
    """(vector, ids, asked): distinct vectors with their least ids, and whether some id is a query."""
    salted = Window.partitionBy("vector", "salt").orderBy("vec_id")
    # repeated rows go first: they are one id, and must not take the places of others
    rows = vectors.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
    asked = rows.filter(F.col("vec_id") % every == 0).select("vector", F.lit(True).alias("asked")).distinct()
    few = rows.withColumn("turn", F.row_number().over(salted)).filter(F.col("turn") <= keep)
    least = few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))
    return least.join(asked, "vector", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0").filter(fine)
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.filter(F.size("vector") == (width.width if width else 0))
    # ids with several vectors, told apart by hashes: one short row an id is shuffled
    mark = F.xxhash64("vector")
    several = rows.groupBy("vec_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo < hi").select("vec_id")
    least = cut_lineage(rows.join(cut_lineage(several, "vector-several"), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("least")), "vector-least")
    return rows.join(least, "vec_id", "left").filter("least IS NULL OR vector = least").select("vec_id", "vector")


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


class Best:
    """The k + 1 nearest (distance, id) of a query so far."""

    def __init__(self, keep: int) -> None:
        self.keep, self.pairs, self.limit = keep, [], math.inf

    def add(self, distances: np.ndarray, ids: list[np.ndarray]) -> None:
        close = np.flatnonzero(distances <= self.limit)
        if len(close):
            self.pairs = sorted(self.pairs + [(float(distances[i]), int(v)) for i in close for v in ids[i]])[: self.keep]
            if len(self.pairs) == self.keep:
                self.limit = self.pairs[-1][0]


def search(keep: int, sure: float, dims: int):
    stop = quantile(sure, dims)

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            vectors, ids = matrix(index.vector), list(index.ids)
            tree = Tree(matrix(index.point), LEAF)
            for qid, vector, point, limit in zip(queries.qid, queries.vector, queries.point, queries.limit):
                best, q = Best(keep), np.asarray(vector, np.float64)
                best.limit = limit
                for gap, own in tree.near(np.asarray(point, np.float64)):
                    if gap > stop * best.limit**2:
                        break
                    best.add(np.sqrt(((vectors[own] - q) ** 2).sum(axis=1)), [ids[i] for i in own])
                out.append((qid, [d for d, _ in best.pairs], [i for _, i in best.pairs]))
        return pd.DataFrame(out, columns=["qid", "distances", "found"])

    return run


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, sure: float = 0.99, dims: int = DIMS, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest of each row whose id is divisible by ``every``."""
    spark, keep = embeddings.sparkSession, k + 1
    rows = usable(embeddings)
    table = cut_lineage(classes(rows, keep, every), "vector-classes")
    n = table.count()
    first = table.select(F.size("vector").alias("width")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projection = np.random.default_rng(seed).normal(size=(first.width, dims))
    chosen = table.filter(F.shiftrightunsigned(F.xxhash64(F.col("ids")[0], F.lit(seed)), 11) / float(1 << 53) < SAMPLE / n).select("vector").limit(2 * SAMPLE)
    sample = np.array([r.vector for r in chosen.toLocalIterator()], np.float64).reshape(-1, first.width) @ projection
    depth = min(12, max(0, math.ceil(math.log2(max(1, n / CELL)))))
    shared = Shared(spark, (projection, Cells(sample, depth)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix_, cells = shared()
        for f in frames:
            if len(f):
                points = matrix(f.vector) @ matrix_
                yield f.assign(point=list(points), cell=cells(points))

    fields = "vector array<double>, ids array<long>, asked boolean, point array<double>, cell long"
    placed = cut_lineage(table.mapInPandas(place, fields), "vector-cells")
    sizes = placed.groupBy("cell").count().collect()
    parts = {r["cell"]: max(1, math.ceil(r["count"] / (2 * CELL))) for r in sizes}
    part_of = F.create_map(*(F.lit(x) for item in parts.items() for x in item))
    index = placed.withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), part_of[F.col("cell")])).select("cell", "part", "vector", "ids", "point")
    corners = [f(F.col("point")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("low", F.min), ("high", F.max))]
    boxes = {r["cell"]: ([r[f"low{i}"] for i in range(dims)], [r[f"high{i}"] for i in range(dims)]) for r in placed.groupBy("cell").agg(*corners).collect()}
    questions = placed.filter("asked").select(F.col("ids")[0].alias("qid"), "vector", "point", "cell")

    def searched(asked: DataFrame) -> DataFrame:
        dealt = asked.withColumn("part", F.explode(F.sequence(F.lit(0), part_of[F.col("cell")] - 1)))
        grouped = index.groupBy("cell", "part").cogroup(dealt.select("cell", F.col("part").cast("long").alias("part"), "qid", "vector", "point", "limit").groupBy("cell", "part"))
        return grouped.applyInPandas(search(keep, sure, dims), "qid long, distances array<double>, found array<long>")

    def best(results: DataFrame) -> DataFrame:
        pairs = F.flatten(F.collect_list(F.arrays_zip("distances", "found")))
        return results.groupBy("qid").agg(F.slice(F.array_sort(pairs), 1, keep).alias("pairs"))

    home = cut_lineage(best(searched(questions.withColumn("limit", F.lit(math.inf)))), "near-home")
    bounds = Shared(spark, boxes)
    stop = quantile(sure, dims)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_boxes = bounds()
        cells = np.array(list(all_boxes), np.int64)
        low, high = (np.array([b[i] for b in all_boxes.values()]) for i in (0, 1))
        for f in frames:
            out = []
            for qid, vector, point, cell, limit in zip(f.qid, f.vector, f.point, f.cell, f.limit):
                gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
                for c in cells[((gap**2).sum(axis=1) <= stop * limit**2) & (cells != cell)]:
                    out.append((qid, vector, point, c, limit))
            yield pd.DataFrame(out, columns=["qid", "vector", "point", "cell", "limit"])

    reach = F.when(F.size("pairs") == keep, F.col("pairs")[keep - 1]["distances"]).otherwise(F.lit(math.inf))
    limited = questions.join(home.select("qid", reach.alias("limit")), "qid")
    others = limited.select("qid", "vector", "point", "cell", "limit").mapInPandas(route, "qid long, vector array<double>, point array<double>, cell long, limit double")
    home_rows = home.select("qid", F.expr("transform(pairs, p -> p.distances)").alias("distances"), F.expr("transform(pairs, p -> p.found)").alias("found"))
    merged = best(home_rows.union(searched(others)))
    owners = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct()
    named = placed.filter("asked").select(F.col("vector").alias("own"), F.col("ids")[0].alias("qid"))
    asked = owners.join(named, F.col("vector") == F.col("own")).select(F.col("vec_id").alias("query_id"), "qid").join(merged, "qid")
    ranked = asked.select("query_id", F.posexplode(F.slice(F.expr("filter(pairs, p -> p.found <> query_id)"), 1, k)).alias("rank", "pair"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("pair.found").alias("vec_id"), F.col("pair.distances").alias("score"))

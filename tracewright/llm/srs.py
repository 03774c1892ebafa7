"""Approximate nearest neighbours by stable projections, a kd-tree, and a chi-square stopping test (SRS, Sun et al. 2014).

Unit vectors are projected to a few dimensions by a seeded Gaussian matrix, so a projected squared distance is the true
one times a chi-square variable. A kd-tree over projected points takes a query's neighbours in order of projected
distance, and verifies each on the full vectors, until the next projected distance is so large that a point nearer than
the k-th best found would have a smaller one with the given confidence.

The tree's upper levels are cut on a bounded sample of projected points and give cells, its lower levels are built within
a cell. A query first searches its own cell; the k-th best found there bounds the projected radius that the test can
reach, and the query goes only to cells whose box lies within that radius. A cell of more than cell_rows points is dealt
out by hash to several trees, and the queries of a cell to several tasks, so a task's memory is bounded by parameters;
every query still meets every tree of a cell. Nothing caps the points of a cell or the candidates of a query.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

LEAF = 64
#: Most points of the sample that cuts the cells, and queries that one task holds beside a tree.
SAMPLE_MOST, QUERY_ROWS = 1 << 18, 16_384
#: Cosines by matrix product that are this near count as equal until they are measured exactly.
ROUNDING = 1e-9


def chi_square_quantile(p: float, dims: int) -> float:
    """The value that a chi-square variable of an even number of degrees of freedom stays below with probability p."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


@dataclass
class Cells:
    """Projection matrix, and the upper tree: split dimension and value per inner node (heap order), and each cell's box."""

    matrix: np.ndarray
    dims: np.ndarray
    values: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        inner = len(self.dims)
        at = np.zeros(len(points), dtype=np.int64)
        while inner and at[0] < inner:
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dims[at]] >= self.values[at])
        return at - inner

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of each point to each cell's box, squared."""
        gap = np.maximum(0, np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]))
        return (gap**2).sum(axis=2)


def cut(p: np.ndarray, matrix: np.ndarray, depth: int) -> Cells:
    """2**depth cells at the medians of the widest dimension of the projected sample p."""
    m = matrix.shape[1]
    boxes, parts, dims, values = [(np.full(m, -np.inf), np.full(m, np.inf))], [p], [], []
    for _ in range(depth):
        next_boxes, next_parts = [], []
        for (low, high), x in zip(boxes, parts, strict=True):
            d = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if len(x) else 0
            v = float(np.median(x[:, d])) if len(x) else 0.0
            dims.append(d)
            values.append(v)
            left, right = high.copy(), low.copy()
            left[d], right[d] = min(high[d], v), max(low[d], v)
            next_boxes += [(low, left), (right, high)]
            next_parts += [x[x[:, d] < v], x[x[:, d] >= v]]
        boxes, parts = next_boxes, next_parts
    return Cells(matrix, np.array(dims, dtype=np.int64), np.array(values), np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))


class Tree:
    """kd-tree leaves over a cell's projected points; units are its full unit vectors."""

    def __init__(self, units: np.ndarray, projected: np.ndarray):
        leaves, todo = [], [np.arange(len(units))]
        while todo:
            rows = todo.pop()
            spread = projected[rows].max(axis=0) - projected[rows].min(axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= LEAF or not spread.any():
                leaves.append(rows)
                continue
            d = int(np.argmax(spread))
            order = rows[np.argsort(projected[rows, d], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.leaves = [x for x in leaves if len(x)]
        self.units = units
        self.low = np.array([projected[x].min(axis=0) for x in self.leaves])
        self.high = np.array([projected[x].max(axis=0) for x in self.leaves])

    def search(self, unit: np.ndarray, projected: np.ndarray, k: int, factor: float, bound: float) -> np.ndarray:
        """Rows verified that may be among the k nearest, ties with the k-th included: leaves by projected distance until the stopping test holds.

        bound: a squared distance within which k points are known elsewhere.
        """
        gap = np.maximum(0, np.maximum(self.low - projected, projected - self.high))
        far = (gap**2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        rows, cos, at, step, best = [], [], 0, 1, bound
        while at < len(order) and far[order[at]] <= factor * best:
            some = np.concatenate([self.leaves[i] for i in order[at : at + step]])
            rows.append(some)
            cos.append(self.units[some] @ unit)
            every = np.concatenate(cos)
            if len(every) >= k:
                best = min(bound, max(0.0, 2 - 2 * float(np.partition(every, len(every) - k)[len(every) - k])) * (1 + 1e-9) + 1e-12)
            at, step = at + step, min(step * 2, 8)
        if not rows:
            return np.empty(0, dtype=np.int64)
        rows, every = np.concatenate(rows), np.concatenate(cos)
        if len(every) <= k:
            return rows
        return rows[every >= np.partition(every, len(every) - k)[len(every) - k] - ROUNDING]


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector a with the rows of b, in double precision, each by the same order of operations."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def _valid(vec_col: str) -> Column:
    c = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(c, lambda x: x != 0)


def _direction(raw: np.ndarray) -> np.ndarray:
    """Vectors over their largest component: equal results have exactly equal cosines with any vector. -0.0 is 0.0."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return np.where(raw == 0, 0.0, raw)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 8, confidence: float = 0.97, cell_rows: int = 8192, sample_rows: int = 16384, seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest cosine found for each row that meets the condition, itself left out.

    Ties go to the smaller id, however many there are. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without an id. Vectors of different lengths have no cosine: each length is
    searched by itself. Rows with the same id and vector count once. Vectors of one direction are one point with their
    k + 1 smallest ids, and their queries are searched once, so copies of a vector cost no task more than their number.
    Fewer candidates than k: all of them. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where(_valid("v")).where("id is not null")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").collect():  # one length, as a rule
        out = out.unionByName(_nearest(rows.where(F.size("v") == r["s"]), r["s"], r["count"], k, dims, confidence, cell_rows, sample_rows, seed))
    return out


def _sample(rows: DataFrame, matrix: np.ndarray, n: int, most: int, seed: int) -> np.ndarray:
    """Projected points of about most of the n rows, distinct vectors by hash; only projections come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                p = _unit(raw) @ matrix
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p], pa.binary())], names=["p"])

    share = min(1.0, 1.3 * most / n + 64 / n)
    some = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "v"), 11).cast("double") / float(1 << 53) < share).select("v").distinct().limit(2 * most)
    got = some.mapInArrow(run, "p binary").collect()
    return np.frombuffer(b"".join(r["p"] for r in got), dtype=np.float64).reshape(-1, matrix.shape[1])


def _nearest(rows: DataFrame, length: int, n: int, k: int, dims: int, confidence: float, cell_rows: int, sample_rows: int, seed: int) -> DataFrame:
    """The search among n vectors of one length. The driver holds the cells' boxes and numbers, SAMPLE_MOST / 8 cells at most."""
    spark = rows.sparkSession
    matrix = np.random.default_rng(seed).standard_normal((length, dims))
    sample = _sample(rows, matrix, n, max(sample_rows, min(SAMPLE_MOST, 16 * n // cell_rows)), seed)
    depth = max(0, min(math.ceil(math.log2(max(1, n / cell_rows))), int(math.log2(max(1, len(sample) / 8)))))
    shared = spark.sparkContext.broadcast(cut(sample, matrix, depth))
    factor = chi_square_quantile(confidence, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw = _direction(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            is_query = batch.column(2).to_numpy(zero_copy_only=False)
            cell = cells.of(_unit(raw) @ cells.matrix)
            met: dict[bytes, int] = {}
            keep, key = [], []
            for i in np.argsort(ids, kind="stable"):
                b = raw[i].tobytes()
                met[b] = met.get(b, 0) + 1
                if met[b] <= k + 1 or is_query[i]:
                    keep.append(i)
                    key.append(hashlib.md5(b).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(key), pa.array(ids[keep]), pa.array([raw[i].tobytes() for i in keep], pa.binary()), pa.array(is_query[keep])], names=["cell", "key", "id", "v", "q"])

    placed = materialize(rows.mapInArrow(place, "cell long, key string, id long, v binary, q boolean"), "srs-points")
    asked = materialize(placed.where("q").groupBy("key").agg(F.first("v").alias("v"), F.first("cell").alias("cell")), "srs-queries")
    first = Window.partitionBy("cell", "key").orderBy("id")
    ids = placed.select("cell", "key", "id").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    ids = ids.groupBy("cell", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = materialize(placed.groupBy("cell", "key").agg(F.first("v").alias("v")).join(ids, ["cell", "key"]), "srs-index")
    trees = _dealt(points, cell_rows)

    def search(table: pa.Table) -> pa.Table:
        cells = shared.value
        q = table.column("q").to_numpy()
        raw = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float64).reshape(len(q), length)
        keys, ids, bounds = table.column("key").to_pylist(), table.column("ids").to_pylist(), table.column("bound").to_numpy()
        own = np.flatnonzero(~q)
        out: list[tuple] = []
        if len(own):
            units = _unit(raw[own])
            tree = Tree(units, units @ cells.matrix)
            for i in np.flatnonzero(q):
                u = _unit(raw[i : i + 1])[0]
                got = own[tree.search(u, u @ cells.matrix, k + 1, factor, float(bounds[i]))]
                score = cosine(raw[i], raw[got]) if len(got) else []
                found = sorted((-s, x) for s, g in zip(score, got, strict=True) for x in ids[g])[: k + 1]
                out += [(keys[i], x, -s) for s, x in found]
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["key", "id", "score"])

    def searched(queries: DataFrame) -> DataFrame:
        """Every query (key, v, cell, bound) against every tree of its cell."""
        parts = _dealt(queries, QUERY_ROWS)
        numbers = F.broadcast(trees.join(parts.withColumnRenamed("parts", "tasks"), "cell"))  # a row a cell
        tree = F.pmod(F.xxhash64("key"), F.col("parts"))
        side = points.join(numbers, "cell").select("cell", tree.alias("tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(False).alias("q"), "key", "ids", "v", F.lit(float("inf")).alias("bound"))
        task = F.pmod(F.xxhash64(F.lit(1), "key"), F.col("tasks"))
        sent = queries.join(numbers, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("tree"), task.alias("task"), F.lit(True).alias("q"), "key", F.array().cast("array<long>").alias("ids"), "v", "bound")
        return side.unionByName(sent).groupBy("cell", "tree", "task").applyInArrow(lambda t: search(t), "key string, id long, score double")

    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found = searched(asked.withColumn("bound", F.lit(float("inf")))).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    near = materialize(found, "srs-own")
    reach = near.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(F.col("key").alias("k2"), F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).otherwise(F.lit(float("inf"))).alias("bound"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        at_once = max(1, (1 << 19) // len(cells.low))
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.float64).reshape(-1, length)
                if not len(raw):
                    continue
                own, bound = part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                far = cells.distances(_unit(raw) @ cells.matrix)
                hit = far <= factor * bound[:, None]
                hit[np.arange(len(own)), own] = False
                r, c = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(c), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r)), pa.array(bound[r])], names=["cell", "key", "v", "bound"])

    sent = asked.join(reach, asked.key == reach.k2).select("key", "v", "cell", "bound").mapInArrow(spread, "cell long, key string, v binary, bound double")
    every = near.unionByName(searched(materialize(sent, "srs-sent"))).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    who = placed.where("q").select(F.col("id").alias("query_id"), "key").distinct()
    mine = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    found = who.join(every, "key").where("id <> query_id").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """(cell, parts): into how many parts the rows of a cell are dealt so that each has about most rows at most."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("long").alias("parts"))

"""Approximate nearest neighbours by few Gaussian projections and kd-trees.

A vector's M projections on Gaussian directions are 2-stable: the squared projected distance
of two vectors is their squared distance times a chi-square variable of M degrees. So
neighbours are taken in the order of projected distance, their true distances computed, and
the search stops when the chi-square test holds: the next projected distance, at the k-th
best true distance so far, would be exceeded by a true neighbour with probability under
1 - CONFIDENCE.

The index is spread over the cluster: the upper levels of one kd-tree over the projections
cut the space into cells. They are fitted on a bounded sample (SAMPLE rows, by hash); every
row is put into its cell, and a cell of more than CELL_ROWS rows is cut into parts by a hash
of the row. Each part builds a kd-tree of its own. A query is searched in its own cell first;
with the k-th distance found there it visits only cells whose region passes the test above.
The index is shuffled once for each of the two searches, whatever the number of queries; only
a cell that over QUERY_BLOCK queries visit is held against them in several blocks.

Equal vectors are all at one distance, and ties go to the smaller id, so that a query's
answer can hold of one vector but the k smallest ids that aren't its own. Rows of a vector
beyond its k + 1 smallest ids, and of one id and vector beyond k, can therefore not be in any
answer and are left out of the index: a vector that a third of all rows share is no hot spot.

Cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do null ids. A query's own id is no candidate, also
where rows repeat it; other repeated rows count each. Rows that repeat a query's id and
vector are one query; where an id stands with different vectors, each of these is a query of
its own with ranks from 1 (query_no tells them apart). Ties go to the smaller id. Fewer than
k candidates: all are returned. Other columns are not read.
"""

from __future__ import annotations

import heapq
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, materialise, table

M = 8
K = 10
CONFIDENCE = 0.99
SAMPLE = 1 << 17
CELL_ROWS = 8192
#: Sampled rows to each cell at least, so that cells are about even.
ROWS_PER_CUT = 16
QUERY_BLOCK = 16384
LEAF = 128
#: Of a projection's squared length, what rounding may add to a squared distance: equal vectors
#: of different batches can differ in their projections' last digits.
SLACK = 1e-9
EVERY = 100


def chi_square_bound(m: int, p: float) -> float:
    """t with P(X <= t) = p for a chi-square variable of an even number m of degrees."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        t = (low + high) / 2
        term, tail = 1.0, 1.0
        for j in range(1, m // 2):
            term *= t / 2 / j
            tail += term
        low, high = (t, high) if 1 - exp(-t / 2) * tail < p else (low, t)
    return high


class Tree:
    """A kd-tree over projected points; nodes have the box of their points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes = points, []
        self._add(np.arange(len(points)), leaf)

    def _add(self, rows: np.ndarray, leaf: int) -> int:
        own = self.points[rows]
        low, high = own.min(0), own.max(0)
        at = len(self.nodes)
        self.nodes.append(None)
        axis = int((high - low).argmax())
        if len(rows) <= leaf or high[axis] == low[axis]:
            self.nodes[at] = (low, high, rows, None)
        else:
            order = rows[np.argsort(own[:, axis], kind="stable")]
            half = len(order) // 2
            self.nodes[at] = (low, high, None, (self._add(order[:half], leaf), self._add(order[half:], leaf)))
        return at

    def nearest_first(self, q: np.ndarray):
        """(least squared projected distance of what follows, rows of the next leaf)."""
        heap = [(self._gap(0, q), 0)]
        while heap:
            gap, at = heapq.heappop(heap)
            _, _, rows, children = self.nodes[at]
            if children is None:
                yield gap, rows
            else:
                for c in children:
                    heapq.heappush(heap, (self._gap(c, q), c))

    def _gap(self, at: int, q: np.ndarray) -> float:
        low, high = self.nodes[at][:2]
        d = np.maximum(0, np.maximum(low - q, q - high))
        return float(d @ d)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, projected: np.ndarray, own: int, k: int, bound: float, t: float):
    """The best k candidates within the bound, by (distance, id)."""
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    slack = SLACK * (1 + float(projected @ projected))
    for gap, rows in tree.nearest_first(projected):
        if gap > t * bound * bound + slack:
            break
        rows = rows[ids[rows] != own]
        diff = vectors[rows] - q
        d = np.sqrt((diff * diff).sum(1))
        near = d <= bound
        best_d, best_i = np.concatenate([best_d, d[near]]), np.concatenate([best_i, ids[rows[near]]])
        if len(best_d) > k:
            order = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[order], best_i[order]
        if len(best_d) == k:
            bound = min(bound, float(best_d.max()))
    return best_d, best_i


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common["n"] if common else 0
    return rows.where(F.size("embedding") == size).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def project(rows: DataFrame, m: int = M) -> DataFrame:
    """vec_id, vec and proj: the vector and its projections, as doubles in binary."""

    def run(batches):
        for batch in batches:
            flat, n = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), batch.num_rows
            x = flat.reshape(n, -1) if n else np.zeros((0, 1))
            p = x @ np.random.default_rng(5).normal(size=(x.shape[1], m))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in p], pa.binary())], names=["vec_id", "vec", "proj"])

    return rows.mapInArrow(run, "vec_id bigint, vec binary, proj binary")


def regions(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cells, by medians of the sample along the widest axis."""
    done, todo = [], [(points, np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))]
    while todo and len(todo) + len(done) < cells:
        todo.sort(key=lambda x: -len(x[0]))
        p, low, high = todo.pop(0)
        axis = int((p.max(0) - p.min(0)).argmax()) if len(p) else 0
        cut = float(np.median(p[:, axis])) if len(p) else 0.0
        left = p[:, axis] < cut
        if not len(p) or not left.any() or left.all():
            done.append((p, low, high))
            continue
        up, down = high.copy(), low.copy()
        up[axis] = down[axis] = cut
        todo += [(p[left], low, up), (p[~left], down, high)]
    every = done + todo
    return np.array([x[1] for x in every]), np.array([x[2] for x in every])


def _doubles(column, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, m) if len(column) else np.zeros((0, m))


def within_reach(index: DataFrame, k: int) -> DataFrame:
    """The rows of vec_id and vec that can be in an answer of k rows (see the module)."""
    same = F.row_number().over(Window.partitionBy("vec", "vec_id").orderBy("vec_id"))
    place = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    rows = index.withColumn("__same", same).where(F.col("__same") <= k).drop("__same")
    return rows.withColumn("__place", place).where(F.col("__place") <= k + 1).drop("__place")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, m: int = M, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, query_no, rank, vec_id, score: of each query (vec_id, embedding) its k nearest of vectors."""
    spark, t = vectors.sparkSession, chi_square_bound(m, confidence)
    index = materialise(within_reach(project(valid(vectors), m), k), "projected")
    asked = project(valid(queries).distinct(), m).withColumnRenamed("vec_id", "query_id").withColumn("query_no", F.monotonically_increasing_id())
    asked = materialise(asked, "asked")
    n = index.count()
    points = _doubles([r.proj for r in hash_sample(index.select("vec_id", "proj"), n, sample, "vec_id").collect()], m)
    cells = max(1, min(-(-n // cell_rows), sample // ROWS_PER_CUT))
    low, high = regions(points, cells) if len(points) else (np.full((1, m), -np.inf), np.full((1, m), np.inf))

    def cell_of(p: np.ndarray) -> np.ndarray:
        return np.concatenate([((q[:, None] >= low) & (q[:, None] < high)).all(2).argmax(1) for q in np.array_split(p, max(1, len(p) // 256))]) if len(p) else np.zeros(0, np.int64)

    def put(batches):
        for batch in batches:
            cell = cell_of(_doubles(batch.column("proj").to_pylist(), m))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    placed = materialise(index.mapInArrow(put, "vec_id bigint, vec binary, proj binary, cell bigint"), "cells")
    parts = {r["cell"]: -(-r["count"] // cell_rows) for r in placed.groupBy("cell").count().collect()}  # a row a cell

    def visits(first: bool):
        """Each query once for every cell with rows that it visits."""
        filled = np.zeros(len(low), bool)
        filled[list(parts)] = True

        def run(batches):
            for batch in batches:
                p = _doubles(batch.column("proj").to_pylist(), m)
                home = cell_of(p)
                bound = np.full(len(p), np.inf) if first else batch.column("bound").to_numpy(zero_copy_only=False)
                at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, q in enumerate(p):
                    if first:
                        found = home[i : i + 1]
                    else:
                        gap = np.maximum(0, np.maximum(low - q, q - high))
                        found = np.flatnonzero((gap * gap).sum(1) <= t * bound[i] * bound[i] + SLACK * (1 + q @ q))
                        found = found[found != home[i]]
                    found = found[filled[found]]
                    at.append(np.full(len(found), i))
                    to.append(found)
                pick = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(pick)) for c in ("query_no", "query_id", "vec", "proj")), pa.array(bound[pick]), pa.array(np.concatenate(to))],
                    names=["query_no", "query_id", "vec", "proj", "bound", "cell"],
                )

        return run

    def look(queries_: pd.DataFrame, rows_: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(queries_) and len(rows_):
            p = _doubles(list(rows_.proj), m)
            vectors_, ids = np.frombuffer(b"".join(rows_.vec), np.float64).reshape(len(rows_), -1), rows_.vec_id.to_numpy()
            tree = Tree(p)
            for no, own, q, proj, bound in zip(queries_.query_no, queries_.query_id, queries_.vec, queries_.proj, queries_.bound, strict=True):
                d, i = search(tree, vectors_, ids, np.frombuffer(q, np.float64), np.frombuffer(proj, np.float64), own, k, bound, t)
                for column, values in zip(out, ([no] * len(d), [own] * len(d), i.tolist(), d.tolist()), strict=True):
                    column.extend(values)
        return pd.DataFrame({c: np.array(x, np.float64 if c == "score" else np.int64) for c, x in zip(("query_no", "query_id", "vec_id", "score"), out, strict=True)})

    def searched(visiting: DataFrame, tag: str) -> DataFrame:
        """The visits' candidates; a cell's rows stand once in each of its parts and blocks of visits."""
        visiting = materialise(visiting, f"{tag}-visits")
        crowd = {r["cell"]: -(-r["count"] // query_block) for r in visiting.groupBy("cell").count().collect()}  # a row a cell
        plan = [(int(c), n_parts, crowd[c]) for c, n_parts in parts.items() if c in crowd]
        plan = spark.createDataFrame(plan, "cell bigint, parts int, blocks int")
        keys = ["cell", "part", "block"]
        rows = placed.join(F.broadcast(plan), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts")).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
        seen = visiting.join(F.broadcast(plan), "cell").withColumn("block", F.pmod(F.xxhash64("query_no"), F.col("blocks")).cast("int"))
        seen = seen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
        return materialise(seen.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(look, "query_no bigint, query_id bigint, vec_id bigint, score double"), tag)

    order = Window.partitionBy("query_no").orderBy("score", "vec_id")
    shape = "query_no bigint, query_id bigint, vec binary, proj binary, bound double, cell bigint"
    home = searched(asked.mapInArrow(visits(True), shape), "home")
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_no", F.col("score").alias("bound"))
    bounded = asked.join(kth, "query_no", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = searched(bounded.select("query_no", "query_id", "vec", "proj", "bound").mapInArrow(visits(False), shape), "others")
    every = home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return every.select("query_id", "query_no", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0)).drop("query_no")


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLES: dict[str, str] = {}

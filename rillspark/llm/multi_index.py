"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook; a pair
of centroids is a cell. For a query the cells are walked in the order of their
summed distance (here: of the largest summed inner product), with a heap over
the sorted centroid pairs, until the cells hold enough vectors. Those are then
reranked by the exact inner product in double precision. How many are enough is
measured: the smallest share of all vectors that finds RECALL of the true
neighbours of PROBES vectors within the sample that codebooks are fitted on. In
the whole table the nearest lie nearer than in a sample, so this errs on the safe side.

Equal vectors are indexed once with their members, so a vector with many copies
is compared once. Cells are packed into blocks of bounded size, crowded ones cut into
several; blocks meet the queries that visit them by a shuffle, at most about ASKED
queries and BLOCK vectors in a group, and each group passes on its best rows only.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Different vectors that codebooks are fitted on, at most (those of smallest hash), and centroids of each half.
FIT_ROWS, CENTROIDS, ROUNDS = 20_000, 64, 15
#: Recall that is aimed at in the sample, vectors that it is measured on, and shares that are tried.
RECALL, PROBES = 0.94, 200
SHARES = (*(x / 100 for x in range(1, 10)), *(x / 40 for x in range(4, 41)))
#: Groups that copies of a vector are dealt into before their smallest ids meet.
SALTS = 16
#: Vectors in a block of cells, and queries that meet a block in one task, about.
BLOCK, ASKED = 8_192, 2_048


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and some not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        for j in np.flatnonzero(n):
            centres[j] = rows[near == j].mean(0)
    return centres


class Codebooks:
    def __init__(self, rows: np.ndarray, centroids: int = CENTROIDS, seed: int = 7):
        self.half = max(1, rows.shape[1] // 2)
        self.first, self.second = kmeans(rows[:, : self.half], centroids, seed), kmeans(rows[:, self.half :], centroids, seed + 1)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row: its nearest centroid in both halves."""
        near = [(part @ c.T - (c**2).sum(1) / 2).argmax(1) for part, c in ((rows[:, : self.half], self.first), (rows[:, self.half :], self.second))]
        return near[0] * len(self.second) + near[1]

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling summed inner product: a heap holds the next pair of each sorted row reached so far."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        left, right = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[left], b[right]
        heap, reached = [(-(a[0] + b[0]), 0, 0)], 1
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(left[i] * len(b) + right[j])
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and reached < len(a):
                heapq.heappush(heap, (-(a[reached] + b[0]), reached, 0))
                reached += 1


def least_share(books: Codebooks, rows: np.ndarray, k: int, recall: float = RECALL) -> tuple[float, float]:
    """The smallest of SHARES that finds `recall` of the k nearest rows of the first PROBES rows, and the recall it has."""
    n, probes = len(rows), min(PROBES, len(rows))
    cell = books.cells(rows)
    size = np.bincount(cell, minlength=len(books.first) * len(books.second))
    score = rows[:probes] @ rows.T
    score[np.arange(probes), np.arange(probes)] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return SHARES[-1], 1.0
    nearest = np.argpartition(-score, k - 1, axis=1)[:, :k]
    found = np.zeros(len(SHARES))
    for q, near in zip(rows[:probes], nearest, strict=True):
        order = np.fromiter(books.walk(q), np.int64)
        before = np.empty(len(size), np.int64)  # vectors in the cells that are walked before each cell
        before[order] = np.r_[0, np.cumsum(size[order])[:-1]]
        found += [(before[cell[near]] < max(1, int(s * n))).mean() for s in SHARES]
    at = int(np.argmax(found / probes >= recall - 1e-12)) if found[-1] / probes >= recall else len(SHARES) - 1
    return SHARES[at], float(found[at] / probes)


def pack(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each cell: neighbouring small cells share a block, a crowded one has several."""
    out, block, room = {}, 0, BLOCK
    for c in sorted(sizes):
        n = -(-sizes[c] // BLOCK)
        if sizes[c] > room:
            block, room = block + 1, BLOCK
        out[c] = (block, n)
        if n > 1:
            block, room = block + n, BLOCK
        else:
            room -= sizes[c]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probe_share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query, by largest inner product.

    queries: a condition on vec_id that picks the queries; each is searched
    among all rows but itself. probe_share: share of the different vectors that
    a query's visited cells hold; None measures the least that RECALL needs. Ties go to the smaller id; a query with fewer
    than k candidates gets all of those found.

    Rows take no part whose id is null or whose vector is null, empty, zero or
    has a null or non-finite component; so do rows whose length is not the
    commonest (of equally common ones the largest). Of rows with one id the
    smallest vector counts. Empty tables give empty results; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not common:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == common["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))

    # different vectors with their smallest k + 1 ids: one more than any query can use, as it may be among them.
    # Ranks within salted groups drop most copies of a common vector before they meet.
    few = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    index = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    index = cut(index.select(F.xxhash64("v").alias("h"), "v", "ids"), "ann-vectors")
    sample = index.orderBy("h").limit(FIT_ROWS).select("v").toPandas()
    sample = np.array(sample["v"].to_list(), np.float64)
    books = Codebooks(sample)
    share = least_share(books, sample, k)[0] if probe_share is None else probe_share

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(books.cells(_matrix(b.column(1))), pa.int32()), *b.columns], ["cell", *b.schema.names])

    celled = cut(index.mapInArrow(assign, "cell int, h long, v array<double>, ids array<long>"), "ann-cells")
    # one count for each of at most CENTROIDS ** 2 cells
    sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    enough = max(k + 1, int(share * sum(sizes.values())))  # k + 1 different vectors are k candidates at least besides the query
    places = pack(sizes)
    layout = spark.createDataFrame([(c, *p) for c, p in places.items()], "cell int, start int, n int")
    held = celled.join(F.broadcast(layout), "cell").select((F.col("start") + F.pmod("h", "n")).cast("int").alias("block"), "cell", "v", "ids")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, block, cells = [], [], []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else []):
                count, visited = 0, defaultdict(list)
                for c in books.walk(q):
                    if count >= enough:
                        break
                    if c in sizes:
                        count += sizes[c]
                        start, n = places[c]
                        for j in range(start, start + n):
                            visited[j].append(c)
                at += [i] * len(visited)
                block += visited
                cells += visited.values()
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32())), *rows.columns], ["block", "cells", "query_id", "v"])

    asked = rows.where(F.coalesce(queries, F.lit(False))).select(F.col("vec_id").alias("query_id"), "v")
    # a walk costs more than its row weighs, so queries are spread by number and not by size
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    visits = asked.repartition(spread, F.xxhash64("query_id")).mapInArrow(visit, "block int, cells array<int>, query_id long, v array<double>")
    salts = -(-asked.count() // ASKED) or 1
    visits = visits.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))

    def compare(_: tuple, asking: pa.Table, block: pa.Table) -> pa.Table:
        """The best k rows in the visited cells of a block for each of a salt's queries."""
        out: tuple[list, list, list] = ([], [], [])
        if asking.num_rows and block.num_rows:
            cell, x, ids = block.column("cell").to_numpy(), _matrix(block.column("v").combine_chunks()), block.column("ids").to_pylist()
            allowed = np.zeros(len(books.first) * len(books.second), bool)
            for s in range(0, asking.num_rows, 1_024):
                part = asking.slice(s, 1_024)
                for name, cells, q in zip(part.column("query_id").to_pylist(), part.column("cells").to_pylist(), _matrix(part.column("v").combine_chunks()), strict=True):
                    allowed[cells] = True
                    here = np.flatnonzero(allowed[cell])
                    allowed[cells] = False
                    score = (x[here] * q).sum(1)
                    least = np.partition(score, -(k + 1))[-(k + 1)] if len(score) > k + 1 else -np.inf
                    best = sorted((-score[j], i) for j in np.flatnonzero(score >= least).tolist() for i in ids[here[j]] if i != name)[:k]
                    out[0].extend([name] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(-d for d, _ in best)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = visits.groupBy("block", "salt").cogroup(held.groupBy("block", "salt")).applyInArrow(compare, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

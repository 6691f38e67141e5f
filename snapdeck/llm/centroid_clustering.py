"""Operator 11, centroid clustering: Lloyd rounds whose assignment step is Orchard's search.

Every centroid has the list of the other centroids by growing distance. The search for a vector
starts at one centroid and walks its list; a closer centroid takes over at once and the walk goes
on in its list, centroids already compared are marked and skipped. The walk stops at a list entry strictly
beyond twice the current distance: by the triangle inequality nothing from there on is closer or
as close. So the result is the exact nearest centroid, ties to the smaller number.

All arithmetic is on integers: components are floor(SCALE * x), distances are squared, and a new
centroid is the floored mean of exact sums.

Scale: the quantised vectors are written once as packed batches; a round reads them, and every
task sends one sum per cluster and component (k * dims numbers, however many vectors it read), so
no group of vectors ever meets in a task. Only the k centroids pass the driver.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component
are left out; components whose scaled value leaves +-(2**27 - 1) are set to that bound, so that a squared distance
fits a long; fewer than k vectors give as many centroids; equal vectors may be two centroids, of which the smaller
number takes all and the other stays empty and in place; a null id hashes as the empty text and
repeated rows are vectors of their own (equal hashes are ordered by the components); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdeck.llm.common import Scratch, arrow_rows

DIMS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
BOUND = (1 << 27) - 1
BATCH_ROWS = 4096


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, gaps): per centroid the other ones by growing squared distance, ties by number, and that distance."""
    d = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, -1)
    lists = np.argsort(d, axis=1, kind="stable")[:, 1:]
    return lists, np.take_along_axis(d, lists, 1)


def nearest(x: np.ndarray, centroids: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of ``x``; all rows walk their lists together."""
    n, k = len(x), len(centroids)
    lists, gaps = neighbour_lists(centroids)

    def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        gap = x[rows] - centroids[to]
        return np.einsum("ij,ij->i", gap, gap)

    best = np.full(n, start)
    dist = distance(np.arange(n), best)
    place = np.zeros(n, np.int64)
    marked = np.zeros((n, k), bool)
    marked[:, start] = True
    live = np.arange(n)
    while True:
        live = live[place[live] < k - 1]
        live = live[gaps[best[live], place[live]] <= 4 * dist[live]]
        if not len(live):
            return best, dist
        at = lists[best[live], place[live]]
        place[live] += 1
        new = ~marked[live, at]
        rows, at = live[new], at[new]
        marked[rows, at] = True
        d = distance(rows, at)
        closer = (d < dist[rows]) | ((d == dist[rows]) & (at < best[rows]))
        rows = rows[closer]
        best[rows], dist[rows], place[rows] = at[closer], d[closer], 0


def _matrices(parts: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in parts:
        for ids, data in zip(b.column(0), b.column(1), strict=True):
            yield ids.values, np.frombuffer(data.as_py(), "<i4").reshape(-1, dims).astype(np.int64)


def _pack(dims: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4")
            for i in range(0, b.num_rows, BATCH_ROWS):
                ids = b.column(0).slice(i, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                                                  pa.array([x[dims * i:dims * (i + len(ids))].tobytes()], pa.binary())], names=["ids", "vectors"])
    return run


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _matrices(parts, dims):
            to, _ = nearest(x, centroids)
            n += np.bincount(to, minlength=k)
            for c in np.flatnonzero(np.bincount(to, minlength=k)):
                total[c] += x[to == c].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims)), pa.array(np.tile(np.arange(dims), len(some))),
                                          pa.array(np.repeat(n[some], dims)), pa.array(total[some].ravel())], names=["cluster", "dim", "n", "total"])
    return run


def _assign(centroids: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(parts, centroids.shape[1]):
            to, d = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(to.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) per kept vector, the final centroids)."""
    spark = vectors.sparkSession
    s = Scratch(spark, "centroid-clustering")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    src = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_x"))
    src = src.filter((F.size("_x") == dims) & F.forall("_x", finite))
    limit = lambda v: F.greatest(F.least(F.floor(v), F.lit(BOUND)), F.lit(-BOUND)).cast("int")
    src = src.select("_id", F.transform("_x", lambda x: limit(x * F.lit(float(scale)))).alias("_v"))
    with arrow_rows(spark, BATCH_ROWS):
        packed = s.write(src.mapInArrow(_pack(dims), "ids array<long>, vectors binary"), "vectors", compression="zstd")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = src.orderBy(order, "_v").limit(k).select("_v").collect()
    schema = "id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), []
    centroids = np.array([r[0] for r in first], np.int64)
    for _ in range(rounds):
        sums = (packed.mapInArrow(_sums(centroids), "cluster long, dim long, n long, total long").groupBy("cluster", "dim")
                .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
        centroids = centroids.copy()
        for r in sums:
            centroids[r.cluster, r.dim] = int(r.total) // r.n
    found = s.write(packed.mapInArrow(_assign(centroids), schema), "assigned")
    s.drop("vectors")
    return found.withColumnRenamed("id", id_col), centroids.tolist()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with cluster_inertia, inertia (long) and centroid_sha256; the joined table has one row per centroid."""
    spark = found.sparkSession
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    everything = sum(sums.values())
    rows = [(c, sums.get(c, 0), everything, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
                           T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return found.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster")

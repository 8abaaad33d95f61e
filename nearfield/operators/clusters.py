"""Centers: nearest-center joins, Lloyd's iteration, k-means, and shards with replication.

Centers are a parameter of bounded number (MAX_CENTERS is checked) and go to every task; the vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .knn import matrix, nearest

MAX_CENTERS = 65536
#: Estimate of a shard's index in memory: factor over vectors plus edges, and slack of edges.
OVERHEAD, SLACK = 1.3, 1.3


def fetch_centers(centers: DataFrame, most: int = MAX_CENTERS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, vectors) of (center, cvec)."""
    rows = sorted(centers.select("center", "cvec").limit(most + 1).collect(), key=lambda r: r[0])
    if len(rows) > most:
        raise ValueError(f"more than {most} centers")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def nearest_centers(vectors: DataFrame, centers: tuple[np.ndarray, np.ndarray], k: int = 1) -> DataFrame:
    """(id, rank, center, dist): the ``k`` nearest centers of every row, the lowest number among equals. No shuffle."""
    spark = vectors.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, points = shipped.value
        for b in batches:
            if b.num_rows and len(numbers):
                ids = b.column("id").to_numpy()
                q, c, d = nearest("l2", np.arange(len(ids)), matrix(b.column("vec")), numbers, points, k)
                rank = np.arange(len(q)) % min(k, len(numbers)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rank), pa.array(c), pa.array(d)], ["id", "rank", "center", "dist"])

    return vectors.select("id", "vec").filter("vec IS NOT NULL").mapInArrow(run, "id long, rank long, center long, dist double")


def inverted_index(assigned: DataFrame) -> DataFrame:
    """(center, ids): the ids of each center in order. For reports on bounded tables; a shard is a partition otherwise."""
    return assigned.groupBy("center").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def shard_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("center").agg(F.count(F.lit(1)).alias("n"))


def shard_centers(shards: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, means) of the shards of (shard, vec), a bounded number, for tables that weren't made from centers."""
    mean = shards.select("shard", F.posexplode("vec").alias("pos", "x")).groupBy("shard", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return fetch_centers(mean.groupBy(F.col("shard").alias("center")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("cvec")))


def estimate_shard_counts(vectors: DataFrame, centers, k: int, p: float) -> DataFrame:
    """Shard sizes from a sample with probability ``p``, scaled up."""
    from .filters import sample

    return nearest_centers(sample(vectors, p), centers, k).groupBy("center").agg((F.count(F.lit(1)) / p).alias("estimate"))


def cluster_sums(vectors: DataFrame, centers: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(center, n, total, residual): partial sums of each batch; a row a center and batch goes through the shuffle."""
    spark = vectors.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, points = shipped.value
        n, total, residual = np.zeros(len(numbers), np.int64), np.zeros_like(points), np.zeros(len(numbers))
        for b in batches:
            if b.num_rows:
                rows = matrix(b.column("vec"))
                _, c, d = nearest("l2", np.arange(len(rows)), rows, np.arange(len(numbers)), points, 1)
                np.add.at(n, c, 1)
                np.add.at(total, c, rows)
                np.add.at(residual, c, d)
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([numbers[k]]), pa.array([n[k]]), pa.array([total[k]], pa.list_(pa.float64())), pa.array([residual[k]])], ["center", "n", "total", "residual"])

    return vectors.select("vec").filter("vec IS NOT NULL").mapInArrow(run, "center long, n long, total array<double>, residual double")


def lloyd_iteration(vectors: DataFrame, centers: tuple[np.ndarray, np.ndarray], strict: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(numbers, new centers, residual). An empty cluster keeps its center; with ``strict`` it becomes the zero vector."""
    numbers, points = centers
    new = np.zeros_like(points) if strict else points.copy()
    total, count, residual = np.zeros_like(points), np.zeros(len(numbers)), 0.0
    at = {int(c): k for k, c in enumerate(numbers)}
    merged = cluster_sums(vectors, centers).select("center", "n", "residual", F.posexplode("total").alias("pos", "x")).groupBy("center", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("residual").alias("residual"))
    for r in merged.toLocalIterator():  # centers times dimensions, a bounded number
        k = at[r["center"]]
        total[k, r["pos"]] = r["x"]
        count[k] = r["n"]
        if r["pos"] == 0:
            residual += r["residual"]
    new[count > 0] = total[count > 0] / count[count > 0][:, None]
    return numbers, new, residual


def seed_random(vectors: DataFrame, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``k`` different rows as centers, the first by a hash of the id."""
    rows = vectors.filter("vec IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("vec").collect()
    return np.arange(len(rows), dtype=np.int64), np.array([r[0] for r in rows], np.float64)


def seed_plusplus(sample: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k-means++ on a bounded sample in memory: each next center with probability in proportion to its squared distance."""
    rng = np.random.default_rng(seed)
    points = [sample[int(rng.integers(len(sample)))]]
    best = ((sample - points[0]) ** 2).sum(1)
    while len(points) < min(k, len(sample)) and best.sum() > 0:
        points.append(sample[int(rng.choice(len(sample), p=best / best.sum()))])
        best = np.minimum(best, ((sample - points[-1]) ** 2).sum(1))
    return np.arange(len(points), dtype=np.int64), np.array(points)


def kmeans_local(data: np.ndarray, centers: np.ndarray, reps: int = 15, tol: float = 1e-5) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample in memory, until the residual gains less than ``tol``; empty clusters stay."""
    last = np.inf
    for _ in range(reps):
        d = (data**2).sum(1)[:, None] - 2 * data @ centers.T + (centers**2).sum(1)[None]
        near = d.argmin(1)
        residual = float(d[np.arange(len(data)), near].sum())
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, data)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        if residual <= 1e-12 or (last - residual) / max(residual, 1e-12) < tol:
            break
        last = residual
    return centers


def kmeans(vectors: DataFrame, k: int, reps: int = 15, tol: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """k-means over all rows: a job an iteration, each a partial sum a task; stops when the residual gains less than ``tol``."""
    numbers, points = seed_random(vectors, k, seed)
    last = np.inf
    for _ in range(reps):
        _, points, residual = lloyd_iteration(vectors, (numbers, points))
        if residual <= 1e-12 or (last - residual) / max(residual, 1e-12) < tol:
            break
        last = residual
    return numbers, points, residual


def index_gb(n: float, dim: int, degree: int, element_bytes: int = 4) -> float:
    """Memory an index of ``n`` rows takes, in GB."""
    return OVERHEAD * (n * dim * element_bytes + n * degree * 4 * SLACK) / 2**30


def to_shards(vectors: DataFrame, centers: tuple[np.ndarray, np.ndarray], k_base: int = 2) -> DataFrame:
    """(shard, id, vec): every row in the shards of its ``k_base`` nearest centers."""
    assigned = nearest_centers(vectors, centers, k_base).select("id", F.col("center").alias("shard"))
    return assigned.join(vectors.select("id", "vec"), "id").select("shard", "id", "vec")


def partition(vectors: DataFrame, shards: int, k_base: int = 2, reps: int = 10, seed: int = 0) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """k-means shards with replication, and their centers."""
    numbers, points, _ = kmeans(vectors, shards, reps, seed=seed)
    return to_shards(vectors, (numbers, points), k_base), (numbers, points)


def shards_for_budget(vectors: DataFrame, gb: float, degree: int, k_base: int = 2, p: float = 1.0, least: int = 3, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Centers of the fewest shards, from ``least`` up, of which the largest fits the memory budget."""
    dim = len(vectors.filter("vec IS NOT NULL").select("vec").first()[0])
    shards = least
    while shards <= most:
        numbers, points, _ = kmeans(vectors, shards, reps=5)
        largest = estimate_shard_counts(vectors, (numbers, points), k_base, p).agg(F.max("estimate")).first()[0] or 0
        if index_gb(largest, dim, degree) <= gb:
            return numbers, points
        shards = max(shards + 1, int(shards * min(2.0, index_gb(largest, dim, degree) / gb)))
    raise ValueError(f"not even {most} shards fit {gb} GB")

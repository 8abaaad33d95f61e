"""Product quantisation: training, encoding, look-up tables, asymmetric and symmetric distance, two-phase search.

A model is small and fixed in size: 256 pivots a chunk over the dimensions, whatever the number of rows. It travels to
the tasks; the codes (a byte a chunk) are a narrow column that is scanned instead of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .clusters import kmeans_local
from .knn import by_block, first_k, matrix, precise, top_k

MAX_CHUNKS = 100
PIVOTS = 256
MAX_PIVOTS = 1 << 15
TRAIN_ROWS = 256_000
#: Queries whose look-up tables a task holds: 100 chunks of 256 pivots are 105 MB for them.
QUERIES = 512


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Borders of contiguous chunks: the first ``dim % chunks`` have one dimension more than the rest."""
    small, more = divmod(dim, chunks)
    return [0, *np.cumsum([small + (k < more) for k in range(chunks)]).tolist()]


def chunks_for_budget(gb: float, rows: int, dim: int) -> int:
    """Chunks (bytes a row) that fit a memory budget; of budgets over 1.25 GB, 0.25 GB are set aside."""
    usable = gb - 0.25 if gb - 0.25 > 1 else gb
    return int(min(max(usable * 2**30 // max(rows, 1), 1), dim, MAX_CHUNKS))


@dataclass
class PQModel:
    center: np.ndarray  # the mean that is taken off every vector
    offsets: list[int]
    pivots: list[np.ndarray]  # for each chunk, pivot by dimension

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """The nearest pivot of each chunk, the first among equals. There are at most MAX_PIVOTS, so that a code is 16 bits."""
        if max(map(len, self.pivots)) > MAX_PIVOTS:
            raise ValueError(f"more than {MAX_PIVOTS} pivots")
        x = rows - self.center
        out = np.empty((len(rows), len(self.pivots)), np.int16)
        for c, p in enumerate(self.pivots):
            part = x[:, self.offsets[c] : self.offsets[c + 1]]
            out[:, c] = ((part[:, None, :] - p[None]) ** 2).sum(2).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([p[codes[:, c]] for c, p in enumerate(self.pivots)], 1) + self.center

    def table(self, query: np.ndarray) -> np.ndarray:
        """Chunk by pivot: squared distance of the query's chunk to each pivot."""
        x = query - self.center
        width = max(len(p) for p in self.pivots)
        out = np.full((len(self.pivots), width), np.inf)
        for c, p in enumerate(self.pivots):
            out[c, : len(p)] = ((p - x[self.offsets[c] : self.offsets[c + 1]]) ** 2).sum(1)
        return out

    def symmetric(self) -> np.ndarray:
        """Chunk by pivot by pivot: squared distances among pivots."""
        width = max(len(p) for p in self.pivots)
        out = np.full((len(self.pivots), width, width), np.inf)
        for c, p in enumerate(self.pivots):
            out[c, : len(p), : len(p)] = ((p[:, None] - p[None]) ** 2).sum(2)
        return out


def model_from_rows(rows: np.ndarray, center: np.ndarray, chunks: int) -> PQModel:
    """A model whose pivots are slices of given rows less the center."""
    offsets = chunk_offsets(rows.shape[1], chunks)
    x = rows - center
    return PQModel(center, offsets, [x[:, offsets[c] : offsets[c + 1]].copy() for c in range(chunks)])


def train(vectors: DataFrame, chunks: int, pivots: int = PIVOTS, rows: int = TRAIN_ROWS, reps: int = 15, seed: int = 0) -> PQModel:
    """A model from a bounded sample: the sample is drawn by hash and each chunk is clustered in a task of its own."""
    spark = vectors.sparkSession
    ship(spark)
    drawn = vectors.filter("vec IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).select("id", F.col("vec").cast("array<double>").alias("vec")).cache()
    first = drawn.first()
    if first is None:
        raise ValueError("no vectors to learn from")
    dim = len(first["vec"])
    offsets = chunk_offsets(dim, chunks)
    center = np.array([r[1] for r in sorted(drawn.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x")).collect())])
    cuts = F.array(*[F.struct(F.lit(c).alias("chunk"), F.slice("vec", offsets[c] + 1, offsets[c + 1] - offsets[c]).alias("part")) for c in range(chunks)])
    parts = drawn.select("id", F.explode(cuts).alias("s")).select("id", "s.chunk", "s.part")

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        c = key[0].as_py()
        t = t.sort_by("id")
        x = matrix(t.column("part")) - center[offsets[c] : offsets[c + 1]]
        start = x[np.sort(np.random.default_rng(seed + c).permutation(len(x))[:pivots])]
        found = kmeans_local(x, start, reps * (2 if len(x) > 512 else 1))
        return pa.table({"chunk": pa.array([c] * len(found), pa.int32()), "code": pa.array(range(len(found)), pa.int32()), "cvec": pa.array(found.tolist(), pa.list_(pa.float64()))})

    found = parts.groupBy("chunk").applyInArrow(learn, "chunk int, code int, cvec array<double>").collect()
    drawn.unpersist()
    by_chunk = {c: np.array([r.cvec for r in sorted(found, key=lambda r: r.code) if r.chunk == c]) for c in range(chunks)}
    return PQModel(center, offsets, [by_chunk[c] for c in range(chunks)])


def encode(vectors: DataFrame, model: PQModel) -> DataFrame:
    """(id, codes) of every row; no shuffle."""
    spark = vectors.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                codes = shipped.value.encode(matrix(part.column("vec")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(codes.tolist(), pa.list_(pa.int16()))], ["id", "codes"])

    return vectors.select("id", "vec").filter("vec IS NOT NULL").mapInArrow(run, "id long, codes array<smallint>")


def tables(queries: DataFrame, model: PQModel) -> DataFrame:
    """(qid, chunk, code, d): the look-up table of every query in long form."""
    spark = queries.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for qid, q in zip(b.column("qid").to_pylist(), matrix(b.column("qvec")), strict=True):
                lut = shipped.value.table(q)
                c, k = np.nonzero(np.isfinite(lut))
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(c), pa.int64()), pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(lut[c, k])], ["qid", "chunk", "code", "d"])

    return queries.select("qid", "qvec").mapInArrow(run, "qid long, chunk int, code int, d double")


def adc(codes: Column, table: Column) -> Column:
    """Asymmetric distance from a row's codes and a query's table (array of arrays)."""
    return F.aggregate(F.zip_with(codes, table, lambda c, t: F.get(t, c.cast("int"))), F.lit(0.0), lambda acc, x: acc + x)


def adc_top(codes: DataFrame, queries: DataFrame, model: PQModel, top: int) -> DataFrame:
    """(qid, rank, id, dist): the ``top`` rows of least asymmetric distance; only the codes are read."""
    spark = codes.sparkSession
    ship(spark)

    def answer(qids, vectors):
        shipped = spark.sparkContext.broadcast((qids, vectors, model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vectors, model = shipped.value
            luts = np.array([model.table(q) for q in vectors])  # made where they are used, for a block of QUERIES
            chunks = np.arange(luts.shape[1])
            held = None
            for b in batches:
                if not b.num_rows:
                    continue
                ids, rows = b.column("id").to_numpy(), matrix(b.column("codes"), np.int64)
                found = [] if held is None else [held]
                for qid, lut in zip(qids, luts, strict=True):
                    d = lut[chunks, rows].sum(1)
                    limit = np.partition(d, top - 1)[top - 1] if len(d) > top else np.inf
                    near = np.flatnonzero(d <= limit)
                    near = near[np.lexsort((ids[near], d[near]))[:top]]
                    found.append((np.full(len(near), qid), ids[near], d[near]))
                held = first_k(found, top)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["qid", "id", "dist"])

        return top_k(codes.select("id", "codes").mapInArrow(run, "qid long, id long, dist double"), top)

    return by_block(queries, answer, QUERIES)


def symmetric_distance(pairs: DataFrame, codes: DataFrame, model: PQModel) -> DataFrame:
    """(a, b, dist) of pairs of ids: distance of their codes through the table of pivot distances."""
    spark = pairs.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(model.symmetric())
    both = pairs.join(codes.select(F.col("id").alias("a"), F.col("codes").alias("ca")), "a").join(codes.select(F.col("id").alias("b"), F.col("codes").alias("cb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = matrix(t.column("ca"), np.int64), matrix(t.column("cb"), np.int64)
                d = shipped.value[np.arange(x.shape[1]), x, y].sum(1)
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(d)], ["a", "b", "dist"])

    return both.select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long, dist double")


def two_phase_knn(vectors: DataFrame, codes: DataFrame, queries: DataFrame, model: PQModel, k: int, top: int, metric: str = "l2") -> DataFrame:
    """The ``k`` nearest of the ``top`` rows by asymmetric distance: the vectors of those alone are fetched and compared."""
    spark = vectors.sparkSession
    candidates = adc_top(codes, queries, model, top).select("qid", "id")
    near = candidates.join(vectors.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, x = matrix(b.column("qvec")), matrix(b.column("vec"))
                d = ((q - x) ** 2).sum(1) if metric == "l2" else np.array([precise(metric, a, c[None])[0] for a, c in zip(q, x, strict=True)])
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("id"), pa.array(d)], ["qid", "id", "dist"])

    return top_k(near.select("qid", "id", "qvec", "vec").mapInArrow(run, "qid long, id long, dist double"), k).select("qid", "rank", "id", "dist")


def residuals(vectors: DataFrame, assigned: DataFrame, centers: DataFrame, back: bool = False) -> DataFrame:
    """(id, vec) less the center each row is assigned to; with ``back`` the center is added again.

    ``assigned`` has (id, center), ``centers`` (center, cvec), a bounded number.
    """
    near = vectors.select("id", "vec").join(assigned.select("id", "center"), "id").join(centers.select("center", "cvec"), "center")
    sign = 1.0 if back else -1.0
    return near.select("id", F.zip_with("vec", "cvec", lambda x, c: x.cast("double") + sign * c.cast("double")).alias("vec"))


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix: the Q of a normal matrix with the signs of R's diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(vectors: DataFrame, turn: np.ndarray, back: bool = False) -> DataFrame:
    """(id, vec) times the matrix, or its transpose, which takes a rotation back."""
    spark = vectors.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(turn.T if back else turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array((matrix(b.column("vec")) @ shipped.value).tolist(), pa.list_(pa.float64()))], ["id", "vec"])

    return vectors.select("id", "vec").filter("vec IS NOT NULL").mapInArrow(run, "id long, vec array<double>")

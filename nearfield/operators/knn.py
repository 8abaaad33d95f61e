"""Exact nearest neighbours of a stated set of queries among all rows.

``exact_knn`` is the main path: a bounded block of queries goes to every task, which computes distances by matrix
products over its Arrow batches and holds the ``k`` nearest rows of each query; one shuffle of at most tasks * queries *
k narrow rows merges them. Query sets beyond BLOCK are taken block by block: the driver holds one block at a time, whose
result is written to the shared folder before the next is fetched. ``knn_plan`` is the same as one lazy plan, for
composition with filters in SQL: a join of blocks of both sides, so that the driver sees neither. ``knn_all`` makes every
row a query without the driver seeing any: rows are routed to clusters that may hold nearer ones by the triangle inequality
and compared on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..session import cut, ship

#: Queries compared in one pass, and matrix cells computed at once in a task.
BLOCK = 2048
CELLS = 1 << 21
#: Cells of a matrix from which candidates are selected, which should stay in a core's cache.
SELECTED = 1 << 20
#: Rows that a cell, or a block of it, should hold, and numbers in the vectors of a block: the larger the blocks, the fewer
#: times a row is sent.
CELL_ROWS = 1 << 15
BLOCK_CELLS = 1 << 22
#: Blocks into which all rows are cut at least where each has LEAST_ROWS, so that there are more pairs of them than cores,
#: and most tasks the pairs are dealt to.
BLOCKS, LEAST_ROWS, PAIR_TASKS = 8, 1 << 11, 1 << 10
#: Share of rows and cells left by the triangle inequality from which on all pairs are compared, each once.
ROUTED = 0.4
#: Neighbours held before they are cut to the nearest.
HELD = 1 << 22
#: Rows of both sides whose distances are worked out at once, which should stay in a core's cache.
TILE = 256, 2048
#: Squared lengths within which single precision selects candidates.
SINGLE = (1e-20, 1e30)


def top_k(df: DataFrame, k: int, by: str = "qid", id: str = "id") -> DataFrame:
    """The ``k`` nearest rows of each query with their rank, in order of (dist, id)."""
    w = Window.partitionBy(by).orderBy("dist", id)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1)


def distances(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Query by base, through one matrix product; right up to rounding."""
    product = queries @ base.T
    if metric == "l2":
        return (queries**2).sum(1)[:, None] - 2 * product + (base**2).sum(1)[None]
    if metric == "inner_product":
        return -product
    norms = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((base**2).sum(1))[None]
    return 1 - np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)


def precise(metric: str, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of one query to a few rows, by direct differences."""
    if metric == "l2":
        return ((rows - query) ** 2).sum(1)
    return distances(metric, query[None], rows)[0]


def slack(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """By how much the product form may be off for each query: rounding in proportion to the squared lengths."""
    if metric != "l2" or not len(base):
        return np.full(len(queries), 1e-9)
    longest = (base**2).sum(1).max()
    return 1e-9 + 8 * np.finfo(np.float64).eps * base.shape[1] * ((queries**2).sum(1) + longest)


def nearest(metric: str, qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, limits: np.ndarray | None = None):
    """(qid, id, dist) of the ``k`` nearest rows of each query; selected by product, settled by direct differences.

    With ``limits`` (NaN: none) rows farther than a query's limit are passed over.
    """
    if metric == "l2":
        return _nearest_l2(qids, queries, ids, base, k, limits)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // max(len(base), 1))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        rough, off = distances(metric, part, base), slack(metric, part, base)
        for row, qid, q, more in zip(rough, qids[at : at + step], part, off, strict=True):
            if len(base) > k:
                limit = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= limit + 2 * more + 1e-9 * abs(limit))
            else:
                near = np.arange(len(base))
            d = precise(metric, q, base[near])
            order = np.lexsort((ids[near], d))[:k]
            out.append((np.full(len(order), qid), ids[near][order], d[order]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _nearest_l2(qids, queries, ids, base, k, limits):
    """``nearest`` by squared distance, a block of queries at once.

    A matrix product gives distances less the query's squared length, in single precision where the lengths allow it; what
    lies within the rounding of the k-th of them, or of the limit, is settled by direct differences in double precision.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(queries) or not len(base):
        return none
    m, dim = base.shape
    lengths, own = (base**2).sum(1), (queries**2).sum(1)
    longest = lengths.max()
    single = SINGLE[0] < longest and max(longest, own.max()) < SINGLE[1]
    kind = np.float32 if single else np.float64
    right = np.concatenate([-2 * base, lengths[:, None]], 1).astype(kind).T
    off = (2 * dim + 16) * np.finfo(kind).eps * (own + longest) + slack("l2", queries, base)
    step = max(1, SELECTED // m)
    out = []
    for at in range(0, len(queries), step):
        q, more = queries[at : at + step], off[at : at + step]
        rough = np.concatenate([q, np.ones((len(q), 1))], 1).astype(kind) @ right
        bound = np.full(len(q), np.inf) if limits is None else limits[at : at + step] - own[at : at + step]
        bound = np.where(np.isnan(bound), np.inf, bound) + more
        free = ~np.isfinite(bound)
        if m > k and free.any():
            bound[free] = _kth(rough if free.all() else rough[free], k) + 2 * more[free]
        if m > k or limits is not None:
            r, c = np.divmod(np.flatnonzero(rough <= _single(bound, kind)[:, None]), m)
            many = np.bincount(r, minlength=len(q)) > 4 * k
            if many.any():  # a limit that leaves far more than k
                bound[many] = np.minimum(bound[many], _kth(rough[many], k) + 2 * more[many])
                left = ~many[r]
                x, y = np.divmod(np.flatnonzero(rough[many] <= _single(bound[many], kind)[:, None]), m)
                r, c = np.concatenate([r[left], np.flatnonzero(many)[x]]), np.concatenate([c[left], y])
        else:
            r, c = np.divmod(np.arange(len(q) * m), m)
        d = np.empty(len(r))
        for i in range(0, len(r), max(1, CELLS // dim)):
            part = slice(i, i + max(1, CELLS // dim))
            d[part] = ((base[c[part]] - q[r[part]]) ** 2).sum(1)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        each = np.bincount(r, minlength=len(q))
        first = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each) < k
        out.append((qids[at : at + step][r[first]], ids[c[first]], d[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def both_ways(ids: tuple[np.ndarray, np.ndarray], vecs: tuple[np.ndarray, np.ndarray], limits: tuple[np.ndarray, np.ndarray], k: int, one: bool = False):
    """(qid, id, dist): up to ``k`` rows within each row's limit (NaN: none) on the other side, for the rows of both sides.

    Each pair is compared once, as in ``nearest`` by squared distance. With ``one`` both sides are the same rows, and a row
    isn't its own neighbour.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    (a, b), m = vecs, len(vecs[1])
    if not len(a) or not m:
        return none
    lengths = [(x**2).sum(1) for x in vecs]
    longest = max(x.max() for x in lengths)
    kind = np.float32 if SINGLE[0] < longest < SINGLE[1] else np.float64
    off = (2 * a.shape[1] + 16) * np.finfo(kind).eps * 2 * longest + max(slack("l2", x, y).max() for x, y in ((a, b), (b, a)))
    left = np.concatenate([a, np.ones((len(a), 1)), lengths[0][:, None]], 1).astype(kind)
    right = np.concatenate([-2 * b, lengths[1][:, None], np.ones((m, 1))], 1).astype(kind).T
    near, far = (_single(np.where(np.isnan(x), np.inf, x) + off, kind) for x in limits)
    every = max(1, CELLS // a.shape[1])
    rough, close, too = np.empty(TILE, kind), np.empty(TILE, bool), np.empty(TILE, bool)
    columns = [(x, np.ascontiguousarray(right[:, x : x + TILE[1]])) for x in range(0, m, TILE[1])]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), TILE[0]):
        rows, found = left[at : at + TILE[0]], []
        for x, part in columns:
            n, w = len(rows), part.shape[1]
            full = (n, w) == TILE
            d, hit, more = (rough, close, too) if full else (np.empty((n, w), kind), np.empty((n, w), bool), np.empty((n, w), bool))
            np.matmul(rows, part, out=d)
            np.less_equal(d, near[at : at + n, None], out=hit)
            if not one:
                np.logical_or(hit, np.less_equal(d, far[x : x + w], out=more), out=hit)
            r, c = np.divmod(np.flatnonzero(hit), w)
            found.append((r + at, c + x))
        r, c = (np.concatenate(x) for x in zip(*found, strict=True))
        if one:
            r, c = r[ids[0][r] != ids[1][c]], c[ids[0][r] != ids[1][c]]
        d = np.concatenate([none[2], *[((b[c[i : i + every]] - a[r[i : i + every]]) ** 2).sum(1) for i in range(0, len(r), every)]])
        for q, i, limit in [(ids[0][r], ids[1][c], limits[0][r]), (ids[1][c], ids[0][r], limits[1][c])][: 1 if one else 2]:
            inside = ~(d > limit * (1 + 1e-9) + 1e-30)
            held.append(first_k([(q[inside], i[inside], d[inside])], k))
        if sum(len(x[0]) for x in held) > HELD:
            held = [first_k(held, k)]
    return first_k(held, k) if held else none


def _kth(rough: np.ndarray, k: int) -> np.ndarray:
    """For each row a number that at least ``k`` of its cells don't exceed: the k-th least, or of long rows that of minima."""
    groups = 16 * k
    if rough.shape[1] < 4 * groups:
        return np.partition(rough, k - 1, axis=1)[:, k - 1].astype(np.float64)
    least = rough[:, :groups].copy()
    for at in range(groups, rough.shape[1] - groups + 1, groups):
        np.minimum(least, rough[:, at : at + groups], out=least)
    return np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64)


def _single(bound: np.ndarray, kind) -> np.ndarray:
    """``bound`` in the type of the distances, never lower."""
    return bound if kind is np.float64 else np.nextafter(bound.astype(np.float32), np.float32(np.inf))


def first_k(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each query among several results."""
    q, i, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    start = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[place < k], i[place < k], d[place < k]


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The query set as blocks (qids, vectors, whether there are more), each fetched when it is asked for."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = sorted(part.select("qid", "qvec").filter("qvec IS NOT NULL").collect(), key=lambda r: r[0])
        if rows:
            yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), blocks > 1


def by_block(queries: DataFrame, answer, block: int = BLOCK) -> DataFrame:
    """The union of ``answer(qids, vectors)`` over all blocks; with more than one, each is written before the next begins."""
    found = None
    for qids, vectors, more in query_blocks(queries, block):
        part = answer(qids, vectors)
        part = cut(part) if more else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "qid long, id long, dist double, rank long")
    return found.select("qid", "rank", "id", "dist")


def exact_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """(qid, rank, id, dist): the ``k`` nearest rows of ``base`` (id, vec) for each of ``queries`` (qid, qvec).

    Fewer than ``k`` rows give all of them; null vectors are never found.
    """
    distance(metric)
    spark = base.sparkSession
    ship(spark)
    rows = base.select("id", "vec").filter("vec IS NOT NULL")

    def answer(qids, vectors):
        shipped = spark.sparkContext.broadcast((qids, vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vectors = shipped.value
            held = None
            for b in batches:
                if b.num_rows:
                    found = nearest(metric, qids, vectors, b.column("id").to_numpy(), matrix(b.column("vec")), k)
                    held = found if held is None else first_k([held, found], k)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["qid", "id", "dist"])

        return top_k(rows.mapInArrow(run, "qid long, id long, dist double"), k)

    return by_block(queries, answer, block)


def knn_plan(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int | None = None) -> DataFrame:
    """``exact_knn`` as one lazy plan: blocks of the base and of the queries are joined, every pair in a task."""
    whole = F.lit(0).cast("long").alias("cell")
    rows = base.filter("vec IS NOT NULL").select(whole, "id", "vec")
    asked = queries.filter("qvec IS NOT NULL").select(whole, "qid", "qvec")
    return top_k(routed(rows, asked, k, metric, asked_rows=block), k).select("qid", "rank", "id", "dist")


def block_rows(vectors: DataFrame, vec: str = "vec") -> int:
    """Rows of a block, by the length of the vectors."""
    first = vectors.filter(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return max(1, min(CELL_ROWS, BLOCK_CELLS // max(1, first[0] if first else 1)))


def routed(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", asked_rows: int | None = None, most: int | None = None, tasks: int | None = None) -> DataFrame:
    """(cell, qid, id, dist): for ``queries`` (qid, qvec, cell[, _reach]) the ``k`` nearest rows of ``base`` (id, vec, cell) in their cell.

    A cell of many rows or queries is cut into blocks of ``most`` rows; every pair of blocks is a group of its own, dealt
    to ``tasks`` tasks where that is given. Rows farther than a query's _reach, where it has one, may be left out.
    """
    distance(metric)
    most = most or block_rows(base)
    count = lambda df, most: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    sizes = count(base, most).withColumnRenamed("_n", "_bases").join(count(queries, asked_rows or most).withColumnRenamed("_n", "_asked"), "cell")
    own = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = base.join(sizes, "cell").select("cell", own("id", "_bases").alias("i"), every("_asked").alias("j"), "id", "vec")
    limited = "_reach" in queries.columns
    asked = queries.join(sizes, "cell").select("cell", every("_bases").alias("i"), own("qid", "_asked").alias("j"), "qid", "qvec", *(["_reach"] if limited else []))

    schema = pa.schema([("cell", pa.int64()), ("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])

    def run(key: tuple, q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return schema.empty_table()
        q, b = q.combine_chunks(), b.combine_chunks()
        limits = q.column("_reach").to_numpy(zero_copy_only=False).astype(float) if limited else None
        found = nearest(metric, q.column("qid").to_numpy(), matrix(q.column("qvec")), b.column("id").to_numpy(), matrix(b.column("vec")), k, limits)
        return pa.table([np.full(len(found[0]), key[0].as_py()), *found], schema=schema)

    ship(base.sparkSession)
    key = ["cell", "i", "j"]
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in key], *[F.col(c).alias(c) for c in asked.columns if c not in key])  # columns of its own
    if tasks:  # small groups of much work would be merged by their size
        asked, rows = asked.repartition(tasks, *[f"q_{c}" for c in key]), rows.repartition(tasks, *key)
    return asked.groupBy(*[f"q_{c}" for c in key]).cogroup(rows.groupBy(*key)).applyInArrow(run, "cell long, qid long, id long, dist double")


def knn_all(vectors: DataFrame, k: int, centers: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(qid, rank, id, dist): the ``k`` exact nearest other rows, by squared distance, of every row (id, vec).

    Rows belong to the cell of their nearest center. Each is first held against its own cell; what it finds bounds how far
    another cell's center may be, less that cell's radius, to hold anything nearer, and it goes to those cells only. Where
    that leaves most cells to most rows, blocks by a hash are compared instead, every pair of rows once for both of them.
    """
    from . import clusters

    rows = vectors.select("id", "vec").filter("vec IS NOT NULL")
    n = rows.count()
    most = min(block_rows(rows), max(LEAST_ROWS, -(-n // BLOCKS)))
    blocks = max(1, -(-n // most))
    if centers is None:
        centers = clusters.seed_random(rows, min(clusters.MAX_CENTERS, blocks))
    near = clusters.nearest_centers(rows, centers)
    placed = cut(near.select("id", F.col("center").alias("cell"), F.col("dist").alias("_far")).join(rows, "id"))
    radius = dict(placed.groupBy("cell").agg(F.max("_far")).collect())  # a number a center
    base = placed.select("id", "vec", "cell")
    asked = placed.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "cell")
    home = routed(base, asked, k + 1, most=most, tasks=min(PAIR_TASKS, 4 * blocks)).select("qid", "id", "dist").filter("qid <> id")
    if len(radius) < 2:
        return top_k(home, k).select("qid", "rank", "id", "dist")
    home = cut(top_k(home, k).select("qid", "id", "dist"))
    reach = home.groupBy("qid").agg(F.max("dist").alias("_reach"), F.count(F.lit(1)).alias("_found"))
    bounded = asked.join(reach, "qid", "left").withColumn("_reach", F.when(F.col("_found") >= k, F.col("_reach")))
    held = [int(c) for c in centers[0] if int(c) in radius]
    points = centers[1][[int(c) in radius for c in centers[0]]]
    far = np.sqrt([radius[c] for c in held])
    shipped = vectors.sparkSession.sparkContext.broadcast((np.array(held, np.int64), points, far))

    def route(batches: Iterator[pa.RecordBatch], count: bool = False) -> Iterator[pa.RecordBatch]:
        numbers, points, far = shipped.value
        for whole in batches:
            step = max(1, CELLS // len(numbers))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                q = matrix(b.column("qvec"))
                d = np.sqrt(np.maximum(distances("l2", q, points) - slack("l2", q, points)[:, None], 0))
                reach = np.sqrt(b.column("_reach").to_numpy(zero_copy_only=False).astype(float))
                own = b.column("cell").to_numpy()
                r, c = np.nonzero(((d - far) * (1 - 1e-9) <= reach[:, None] * (1 + 1e-9)) | np.isnan(reach)[:, None])
                r, c = r[numbers[c] != own[r]], c[numbers[c] != own[r]]
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([len(r)], pa.int64())], ["n"])
                    continue
                yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(r)), b.column("qvec").take(pa.array(r)), pa.array(numbers[c]), b.column("_reach").take(pa.array(r))], ["qid", "qvec", "cell", "_reach"])

    ship(vectors.sparkSession)
    bounded = cut(bounded.select("qid", "qvec", "cell", "_reach"))
    routes = bounded.mapInArrow(lambda batches: route(batches, True), "n long").agg(F.sum("n")).first()[0] or 0
    if routes > ROUTED * n * (len(held) - 1):
        return top_k(all_pairs(bounded.select(F.col("qid").alias("id"), F.col("qvec").alias("vec"), "_reach"), k, blocks), k).select("qid", "rank", "id", "dist")
    others = bounded.mapInArrow(route, f"qid long, qvec {dict(asked.dtypes)['qvec']}, cell long, _reach double")
    return top_k(home.unionByName(routed(base, others, k, most=most, tasks=min(PAIR_TASKS, blocks * blocks)).select("qid", "id", "dist")), k).select("qid", "rank", "id", "dist")


def all_pairs(rows: DataFrame, k: int, blocks: int) -> DataFrame:
    """(qid, id, dist): for each row (id, vec, _reach) up to ``k`` other rows of each block that lie within its _reach.

    A row goes once to each block: its pairs with that block's rows are worked out in one task, for both sides.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = F.least("_own", "_other") * blocks + F.greatest("_own", "_other")
    sides = dealt.select(pair.alias("pair"), (F.col("_own") <= F.col("_other")).alias("first"), "id", "vec", "_reach")
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y = divmod(key[0].as_py(), blocks)
        first = t.column("first")
        sides = [t.filter(first).combine_chunks()] * 2 if x == y else [t.filter(first).combine_chunks(), t.filter(pc.invert(first)).combine_chunks()]
        if not all(s.num_rows for s in sides):
            return schema.empty_table()
        ids, vecs, limits = ([f(s) for s in sides] for f in (lambda s: s.column("id").to_numpy(), lambda s: matrix(s.column("vec")), lambda s: s.column("_reach").to_numpy(zero_copy_only=False).astype(float)))
        return pa.table(list(both_ways(ids, vecs, limits, k, x == y)), schema=schema)

    ship(rows.sparkSession)
    return sides.repartition(min(PAIR_TASKS, 2 * blocks * (blocks + 1)), "pair").groupBy("pair").applyInArrow(run, "qid long, id long, dist double")


def knn_filtered(base: DataFrame, queries: DataFrame, k: int, keep: DataFrame | None = None, drop: DataFrame | None = None, metric: str = "l2") -> DataFrame:
    """Exact neighbours among the rows whose id is in ``keep`` and not in ``drop``: filtered before the search, so that k are found."""
    if keep is not None:
        base = base.join(keep.select("id").distinct(), "id", "left_semi")
    if drop is not None:
        base = base.join(drop.select("id").distinct(), "id", "left_anti")
    return exact_knn(base, queries, k, metric)

"""An index as a directory of Parquet tables: build, open, search, insert, delete and consolidate.

A directory holds versions; each change writes the tables it makes as the next version, whose table ``meta`` is written
last and names the versions of the others. So a change that fails leaves the index as it was, and readers of an older
version are undisturbed. Nodes are stored with their codes in buckets of the shard, so that a search shuffles queries only.

Tables: nodes (shard, id, vec, nbrs, codes), centers (shard, cvec), tags (id, tag), deleted (id), pq_pivots, pq_meta, meta.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..operators import clusters, graphs, layout, mutations, pq
from ..operators.knn import top_k
from ..session import cut
from ..streaming.changes import versions

#: Most buckets that the nodes are stored in.
MAX_BUCKETS = 4096
NODES = "shard bigint, id bigint, vec array<float>, nbrs array<bigint>, codes array<smallint>"


@dataclass(frozen=True)
class Parameters:
    degree: int = 32
    pool: int = 64
    alpha: float = 1.2
    metric: str = "l2"
    shard_rows: int = 4096
    k_base: int = 2
    chunks: int = 8
    saturate: bool = True

    def __post_init__(self):
        if self.metric not in ("l2", "cosine"):
            raise ValueError(f"no index for the metric {self.metric!r}")
        if min(self.degree, self.pool, self.shard_rows, self.k_base, self.chunks) < 1 or self.alpha < 1:
            raise ValueError(f"parameters out of range: {self}")


def unit(p: Parameters, vec) -> F.Column:
    """A vector as the index holds it; over cosine it is normalised, a query without the epsilon of stored vectors."""
    return (normalize(vec) if p.metric == "cosine" else vec).cast("array<float>")


def unit_query(p: Parameters, vec) -> F.Column:
    if p.metric != "cosine":
        return vec.cast("array<double>")
    length = F.sqrt(F.aggregate(F.transform(vec, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return F.transform(vec, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def build(vectors: DataFrame, path: str, p: Parameters | None = None, tags: DataFrame | None = None) -> Index:
    """Write an index of (id, vec): shards are built at the same time; cosine becomes L2 over normalised vectors."""
    p = p or Parameters()
    spark = vectors.sparkSession
    base = cut(vectors.select("id", unit(p, F.col("vec")).alias("vec")).filter("vec IS NOT NULL"))
    n = base.count()
    if not n:
        raise ValueError("no vectors to build an index of")
    shards = max(1, -(-n // p.shard_rows))
    if shards == 1:
        placed = base.select(F.lit(0).cast("long").alias("shard"), "id", "vec")
        own = (np.zeros(1, np.int64), np.zeros((1, len(base.first()["vec"]))))
        degree = p.degree
    else:
        placed, own = clusters.partition(base, shards, min(p.k_base, shards))
        degree = max(2, 2 * p.degree // 3)
    model = pq.train(base, min(p.chunks, len(own[1][0])))
    index = Index(spark, path, p, n, shards, {}, -1)
    index.save_model(model, own)
    nodes = graphs.build_graph(placed, degree, p.pool, p.alpha, p.saturate and shards == 1)
    index.write(nodes=nodes, tags=(tags if tags is not None else layout.identity_tags(base)).select("id", "tag"), deleted=spark.createDataFrame([], "id long"))
    index.check()
    return index


def budget(p: Parameters, rows: int, dim: int, search_gb: float, build_gb: float) -> Parameters:
    """Parameters whose codes fit the memory for searching and whose shards fit the memory for building."""
    chunks = pq.chunks_for_budget(search_gb, rows, dim)
    each = clusters.index_gb(1.0, dim, p.degree)
    return Parameters(**{**asdict(p), "chunks": chunks, "shard_rows": max(1, min(rows, int(build_gb / each / p.k_base)))})


def load_model(spark: SparkSession, path: str) -> pq.PQModel:
    meta = spark.read.parquet(f"{path}/pq_meta").first()
    rows = sorted(spark.read.parquet(f"{path}/pq_pivots").collect(), key=lambda r: (r.chunk, r.code))
    return pq.PQModel(np.array(meta.center), list(meta.offsets), [np.array([r.cvec for r in rows if r.chunk == c]) for c in range(len(meta.offsets) - 1)])


@dataclass
class Index:
    spark: SparkSession
    path: str
    p: Parameters
    rows: int
    shards: int
    at: dict[str, int]
    version: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The newest complete version."""
        known = versions(spark, path, "meta")
        if not known:
            raise ValueError(f"no index at {path}")
        meta = json.loads(spark.read.text(f"{path}/v{known[-1]}/meta").first()[0])
        return cls(spark, path, Parameters(**meta["p"]), meta["rows"], meta["shards"], meta["at"], known[-1])

    def save_model(self, model: pq.PQModel, centers: tuple[np.ndarray, np.ndarray]) -> None:
        spark = self.spark
        rows = [(c, k, [float(x) for x in v]) for c, p in enumerate(model.pivots) for k, v in enumerate(p)]
        spark.createDataFrame(rows, "chunk int, code int, cvec array<double>").write.mode("overwrite").parquet(f"{self.path}/pq_pivots")
        spark.createDataFrame([([float(x) for x in model.center], [int(x) for x in model.offsets])], "center array<double>, offsets array<int>").write.mode("overwrite").parquet(f"{self.path}/pq_meta")
        spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(*centers, strict=True)], "shard long, cvec array<double>").write.mode("overwrite").parquet(f"{self.path}/centers")

    def centers(self) -> tuple[np.ndarray, np.ndarray]:
        return clusters.fetch_centers(self.spark.read.parquet(f"{self.path}/centers").select(F.col("shard").alias("center"), "cvec"))

    def buckets(self) -> int:
        return min(self.shards, MAX_BUCKETS)

    def _name(self, version: int) -> str:
        return f"nearfield_{hashlib.md5(f'{self.path}|{version}'.encode()).hexdigest()}"

    def table(self, name: str) -> DataFrame:
        at = f"{self.path}/v{self.at[name]}/{name}"
        if name != "nodes":
            return self.spark.read.parquet(at)
        known = self._name(self.at[name])
        location = at.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({NODES}) USING parquet CLUSTERED BY (shard) SORTED BY (id) INTO {self.buckets()} BUCKETS LOCATION '{location}'")
        return self.spark.table(known)

    def write(self, **tables: DataFrame) -> None:
        """The next version: the given tables, and the others as they are."""
        version = self.version + 1
        at = dict(self.at)
        for name, df in tables.items():
            to = f"{self.path}/v{version}/{name}"
            if name == "nodes":
                codes = pq.encode(df.select("id", "vec").dropDuplicates(["id"]), load_model(self.spark, self.path)).select("id", "codes")
                whole = df.select("shard", "id", "vec", "nbrs").join(codes, "id").select("shard", "id", "vec", "nbrs", "codes")
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
                whole.repartition(self.buckets(), "shard").write.mode("overwrite").bucketBy(self.buckets(), "shard").sortBy("id").option("path", to).format("parquet").saveAsTable(self._name(version))
            else:
                df.write.mode("overwrite").parquet(to)
            at[name] = version
        self.at, self.version = at, version
        if "nodes" in tables:
            self.rows = self.table("nodes").select("id").distinct().count()
        meta = json.dumps({"p": asdict(self.p), "rows": self.rows, "shards": self.shards, "at": at})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/v{version}/meta")

    def check(self) -> None:
        """Every row is in the graph and has codes."""
        bad = self.table("nodes").filter("codes IS NULL OR vec IS NULL").count()
        found = self.table("nodes").select("id").distinct().count()
        if found != self.rows or bad:
            raise ValueError(f"{self.rows} rows, but {found} in the graph and {bad} without codes")

    def search(self, queries: DataFrame, k: int, pool: int, mode: str = "batch", width: int = 4, use_codes: bool = False, probes: int | None = None, **how) -> DataFrame:
        """(qid, rank, id, tag, dist) of the live rows nearest to ``queries`` (qid, qvec); ``probes`` nearest shards, or all.

        A row without a tag isn't returned.
        """
        if pool < k:
            raise ValueError("the pool must hold k rows")
        q = queries.select("qid", unit_query(self.p, F.col("qvec")).alias("qvec"))
        nodes = self.table("nodes")
        if mode == "page":
            nodes = nodes.withColumn("page", F.floor(F.col("id") / layout.rows_per_page(len(nodes.first()["vec"]), self.p.degree)))
        gone = self.table("deleted")
        found = graphs.search_graph(nodes, q, k, pool, width, mode, load_model(self.spark, self.path) if use_codes else None, None if gone.isEmpty() else gone, centers=self.centers() if probes else None, probes=probes or 0, **how)
        if how.get("stats"):
            return found
        return top_k(found.select("qid", "id", "dist").join(self.table("tags"), "id"), k).select("qid", "rank", "id", "tag", "dist")

    def insert(self, new: DataFrame, probes: int | None = None) -> None:
        """Insert (id, tag, vec); a tag or id that is there already is replaced. Of several rows with a tag the one of the highest id counts."""
        rows = cut(new.filter("vec IS NOT NULL").groupBy("tag").agg(F.max(F.struct("id", unit(self.p, F.col("vec")).alias("vec"))).alias("r")).select("r.id", "tag", "r.vec"))
        tags = self.table("tags")
        old = tags.join(rows.select("tag"), "tag", "left_semi").join(rows.select("id"), "id", "left_anti").select("id")
        nodes = mutations.insert(self.table("nodes"), rows.select("id", "vec"), self.p.degree, self.p.pool, self.p.alpha, self.centers() if probes else None, probes or 0)
        kept = tags.join(rows.select("tag"), "tag", "left_anti").join(rows.select("id"), "id", "left_anti").select("id", "tag")
        gone = self.table("deleted").join(rows.select("id"), "id", "left_anti").union(old).distinct()
        self.write(nodes=nodes, tags=kept.unionByName(rows.select("id", "tag")), deleted=gone)

    def delete(self, wanted: DataFrame, eager: int | None = None) -> DataFrame:
        """Delete the tags of (tag): lazily, or at once by mode 1 or 2; gives the tags that aren't there."""
        left, gone, failed = mutations.lazy_delete(self.table("tags"), self.table("deleted"), wanted)
        failed = cut(failed)
        if eager is None:
            self.write(tags=left, deleted=gone)
        else:
            now = gone.join(self.table("deleted"), "id", "left_anti")
            self.write(nodes=mutations.eager_delete(self.table("nodes"), now, self.p.degree, self.p.alpha, eager), tags=left)
        return failed

    def consolidate(self) -> None:
        """Take the deleted rows out of the graph."""
        self.write(nodes=mutations.consolidate(self.table("nodes"), self.table("deleted"), self.p.degree, self.p.alpha), deleted=self.table("deleted").limit(0))

    def apply(self, changes: DataFrame) -> None:
        """A batch of changes (seq, op, id, tag, vec): the last one of each tag, "insert" or "delete"."""
        last = cut(mutations.upsert_latest(changes.select("tag", "seq", "op", "id", "vec"), "tag", [F.col("seq")]))
        gone = last.filter("op = 'delete'").select("tag")
        if not gone.isEmpty():
            self.delete(gone)
        new = last.filter("op = 'insert' AND vec IS NOT NULL").select("id", "tag", "vec")
        if not new.isEmpty():
            self.insert(new)

    def clear(self) -> None:
        nodes, tags, deleted = mutations.clear(self.table("nodes"), self.table("tags"), self.table("deleted"))
        self.write(nodes=nodes, tags=tags, deleted=deleted)

    def vector_of(self, tag: int) -> list[float] | None:
        return mutations.vector_of(self.table("nodes"), self.table("tags"), tag)


def follow(changes: DataFrame, index: Index, checkpoint: str):
    """Start a query that applies a stream of changes to an index, a version or two a batch. A batch that is replayed gives the same rows again."""
    return changes.writeStream.foreachBatch(lambda batch, _: index.apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""All queries of the library by name, with the SQL each is checked against.

The base is every row of ``embeddings``; searches take as queries the rows whose id is divisible by 50. Centers and
pivots are the first 1024 and 256 of those rows, so that both sides have the same model, of fixed size. Tags are 7 * id + 3; ids that end in 3
count as deleted. Distances are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters, filters, graphs, knn, layout, mutations, pq, stats
from ..session import cut, table
from ..sources import text

K = 10
STEP = 50
CHUNKS = 8
NEIGHBOURS = 8
TOP = 100
PER_PAGE = 5
#: Most centers of the queries about centers, and rows that a shard of the queries about graphs should hold.
CENTERS = 1024
SHARD_ROWS = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# inputs


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(b: DataFrame) -> DataFrame:
    return b.filter(F.col("id") % STEP == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def tags(b: DataFrame) -> DataFrame:
    return b.select("id", (F.col("id") * 7 + 3).alias("tag"))


def deleted(b: DataFrame) -> DataFrame:
    return b.filter(F.col("id") % 10 == 3).select("id")


def centers(b: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    first = asked(b).filter(F.col("qid") < STEP * CENTERS)
    return clusters.fetch_centers(first.select(F.col("qid").alias("center"), F.col("qvec").alias("cvec")))


def model(b: DataFrame) -> pq.PQModel:
    rows = np.array([r[1] for r in sorted(asked(b).filter(F.col("qid") < STEP * pq.PIVOTS).collect())], np.float64)
    return pq.model_from_rows(rows, np.array(stats.centroid(b).first()[0]), CHUNKS)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def shown(found: DataFrame) -> DataFrame:
    """Neighbours as every search shows them."""
    return found.select("qid", "rank", F.col("id").alias("vec_id"), r6("dist").alias("dist"))


def long_form(df: DataFrame, value: Column) -> DataFrame:
    """(vec_id, pos, val) of a vector column, for comparison element by element."""
    return df.select(F.col("id").alias("vec_id"), F.posexplode(value).alias("pos", "val")).select("vec_id", F.col("pos").cast("long").alias("pos"), "val")


# pieces of SQL


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


E_SQL = "e AS (SELECT vec_id AS id, embedding AS vec FROM embeddings)"
Q_SQL = f"q AS (SELECT id AS qid, vec AS qvec FROM e WHERE id % {STEP} = 0)"


def knn_sql(dist: str, where: str = "true", k: int = K, what: str = "qid, rank, id AS vec_id, round(dist, 6) AS dist", more: str = "") -> str:
    return f"""WITH {E_SQL}, {Q_SQL}{more},
s AS (SELECT qid, id, {dist} AS dist FROM q, e WHERE {where}),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s)
SELECT {what} FROM k WHERE rank <= {k}"""


EXACT = knn_sql(l2("qvec", "vec"))
COSINE = f"1 - {dot('qvec', 'vec')} / ({norm('qvec')} * {norm('vec')})"
INT8 = "list_transform({}, lambda x: greatest(-128, least(127, CAST(trunc((x::DOUBLE - 0) * 128) AS INTEGER))))"

# exact search


@query(EXACT)
def knn_exact_l2(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(knn.exact_knn(b, asked(b), K))


@query(EXACT)
def knn_relational_l2(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(knn.knn_plan(b, asked(b), K))


@query(knn_sql(COSINE, what="qid, rank, id AS vec_id, CASE WHEN round(dist, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(dist, 6) END AS dist"))
def knn_exact_cosine(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(knn.exact_knn(b, asked(b), K, "cosine"))


@query(knn_sql("-" + dot("qvec", "vec")))
def knn_inner_product(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(knn.exact_knn(b, asked(b), K, "inner_product"))


@query(knn_sql(l2("qi", "vi"), what="qid, rank, id AS vec_id, CAST(dist AS BIGINT) AS dist").replace("FROM q, e", f"FROM (SELECT qid, {INT8.format('qvec')} AS qi FROM q) q, (SELECT id, {INT8.format('vec')} AS vi FROM e) e"))
def knn_int8(spark, sf_dir):
    b = base(spark, sf_dir).select("id", V.quantize_int8(F.col("vec"), 0, 2).alias("vec"))
    found = knn.exact_knn(b, asked(b), K)
    return found.select("qid", "rank", F.col("id").alias("vec_id"), F.round("dist").cast("long").alias("dist"))


@query(f"WITH {E_SQL}, {Q_SQL} SELECT qid, id AS vec_id, round({dot('qvec', 'vec')} / ({norm('qvec')} * {norm('vec')}), 6) AS similarity FROM q JOIN e ON id BETWEEN qid AND qid + 9")
def cosine_batch(spark, sf_dir):
    b = base(spark, sf_dir)
    near = asked(b).withColumn("id", F.explode(F.sequence("qid", F.col("qid") + 9))).join(b, "id")
    return near.select("qid", F.col("id").alias("vec_id"), r6(V.cosine_similarity(F.col("qvec"), F.col("vec"))).alias("similarity"))


# scalar functions


@query(f"WITH {E_SQL} SELECT id AS vec_id, round({norm('vec')}, 6) AS norm FROM e")
def vec_norm(spark, sf_dir):
    return base(spark, sf_dir).select(F.col("id").alias("vec_id"), r6(V.norm(F.col("vec"))).alias("norm"))


def unnested(value: str, val: str = "round(v[i + 1], 6)") -> str:
    return f"WITH {E_SQL}, x AS (SELECT id, {value} AS v FROM e), y AS (SELECT id, v, unnest(range(0, len(v))) AS i FROM x) SELECT id AS vec_id, i AS pos, {val} AS val FROM y"


@query(unnested(f"list_transform(list_zip(vec, list_transform(vec, lambda z: sqrt({V.EPSILON!r} + {dot('vec', 'vec').replace('p[', 'w[').replace('lambda p', 'lambda w')}))), lambda p: p[1]::DOUBLE / p[2])"))
def vec_normalize(spark, sf_dir):
    out = long_form(base(spark, sf_dir), V.normalize(F.col("vec")))
    return out.withColumn("val", r6("val"))


@query(unnested(INT8.format("vec"), "CAST(v[i + 1] AS BIGINT)"))
def vec_quantize(spark, sf_dir):
    return long_form(base(spark, sf_dir), V.quantize_int8(F.col("vec"), 0, 2)).withColumn("val", F.col("val").cast("long"))


@query(unnested("list_transform(vec, lambda x: ((CAST(trunc(x::DOUBLE * 1000) AS BIGINT) % 256) + 256) % 256)", "CAST(v[i + 1] AS BIGINT)"))
def vec_cast(spark, sf_dir):
    scaled = F.transform("vec", lambda x: x.cast("double") * 1000)
    return long_form(base(spark, sf_dir), V.cast_elements(scaled, "uint8")).withColumn("val", F.col("val").cast("long"))


@query(unnested("list_concat(vec[1:61], [0.0::FLOAT, 0.0::FLOAT, 0.0::FLOAT])", "round(v[i + 1]::DOUBLE, 6)"))
def vec_pad(spark, sf_dir):
    out = long_form(base(spark, sf_dir), V.pad(V.unpad(F.col("vec"), 61)))
    return out.withColumn("val", r6(F.col("val").cast("double")))


@query(f"WITH {E_SQL} SELECT id AS vec_id, round({dot('vec', 'vec')}, 6) AS l2sq FROM e")
def row_l2sq(spark, sf_dir):
    return base(spark, sf_dir).select(F.col("id").alias("vec_id"), r6(V.squared_norm(F.col("vec"))).alias("l2sq"))


# filters


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 100")
def rows_head(spark, sf_dir):
    return filters.head(table(spark, sf_dir, "embeddings"), 100, "vec_id").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 40 AND 89")
def rows_range(spark, sf_dir):
    return filters.row_range(table(spark, sf_dir, "embeddings"), 40, 50, "vec_id").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE ((vec_id % 1073741824 + 1) * 2654435761) % 4294967296 < CAST(trunc(0.1 * 4294967296) AS BIGINT)")
def rows_sample_hash(spark, sf_dir):
    return filters.sample(table(spark, sf_dir, "embeddings"), 0.1, "vec_id", seed=1).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id DESC LIMIT 1")
def rows_sample_or_last(spark, sf_dir):
    return filters.sample_or_last(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 0.0, "vec_id")


@query(EXACT.replace("qid, rank, id AS vec_id", "qid, rank, id AS vec_id, id * 7 + 3 AS tag"))
def tag_join(spark, sf_dir):
    b = base(spark, sf_dir)
    return mutations.live_results(knn.exact_knn(b, asked(b), K), tags(b), K).select("qid", "rank", F.col("id").alias("vec_id"), "tag", r6("dist").alias("dist"))


@query(knn_sql(l2("qvec", "vec"), "id IN (SELECT doc_id FROM labels WHERE toxic = 0)"))
def knn_active_only(spark, sf_dir):
    b = base(spark, sf_dir)
    active = table(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id"))
    return shown(knn.knn_filtered(b, asked(b), K, keep=active))


@query(knn_sql(l2("qvec", "vec"), "id % 10 <> 3"))
def knn_excluding_deleted(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(knn.knn_filtered(b, asked(b), K, drop=deleted(b)))


@query(f"WITH {E_SQL} SELECT id AS vec_id, id * 7 + 3 AS tag FROM e WHERE id % 10 <> 3")
def lazy_delete_tags(spark, sf_dir):
    b = base(spark, sf_dir)
    wanted = tags(b).join(deleted(b), "id").select("tag")
    left, _, _ = mutations.lazy_delete(tags(b), deleted(b).limit(0), wanted)
    return left.select(F.col("id").alias("vec_id"), "tag")


# centers


@query(f"WITH {E_SQL}, x AS (SELECT unnest(range(0, len(vec))) AS pos, vec FROM e) SELECT pos, round(avg(vec[pos + 1]::DOUBLE), 6) AS value FROM x GROUP BY pos")
def centroid(spark, sf_dir):
    return stats.centroid_long(base(spark, sf_dir)).select(F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


MEAN_SQL = "m AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(vec[i]::DOUBLE) AS v FROM (SELECT vec, unnest(range(1, len(vec) + 1)) AS i FROM e) GROUP BY i))"


@query(f"WITH {E_SQL}, {MEAN_SQL}, s AS (SELECT id, {l2('vec', 'c')} AS d FROM e, m) SELECT id AS vec_id, round(d, 6) AS dist FROM s ORDER BY d, id LIMIT 1")
def medoid(spark, sf_dir):
    return stats.medoid(base(spark, sf_dir)).select(F.col("id").alias("vec_id"), r6("dist").alias("dist"))


def centers_sql(k: int, what: str) -> str:
    return f"""WITH {E_SQL}, {Q_SQL}, s AS (SELECT id, qid AS center, {l2("vec", "qvec")} AS d FROM q, e WHERE qid < {STEP * CENTERS}),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, center) AS rank FROM s QUALIFY rank <= {k}) {what}"""


@query(centers_sql(1, "SELECT id AS vec_id, center, round(d, 6) AS dist FROM a"))
def nearest_center(spark, sf_dir):
    b = base(spark, sf_dir)
    return clusters.nearest_centers(b, centers(b)).select(F.col("id").alias("vec_id"), "center", r6("dist").alias("dist"))


@query(centers_sql(2, "SELECT id AS vec_id, rank, center, round(d, 6) AS dist FROM a"))
def nearest_centers_k2(spark, sf_dir):
    b = base(spark, sf_dir)
    return clusters.nearest_centers(b, centers(b), 2).select(F.col("id").alias("vec_id"), "rank", "center", r6("dist").alias("dist"))


@query(centers_sql(1, "SELECT center, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM a GROUP BY center"))
def inverted_index(spark, sf_dir):
    b = base(spark, sf_dir)
    return clusters.inverted_index(clusters.nearest_centers(b, centers(b))).select("center", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(centers_sql(2, "SELECT center, count(*) AS n FROM a GROUP BY center"))
def shard_counts(spark, sf_dir):
    b = base(spark, sf_dir)
    return clusters.shard_counts(clusters.nearest_centers(b, centers(b), 2))


@query(centers_sql(2, "SELECT center AS shard, id AS vec_id, round(e.vec[1]::DOUBLE, 6) AS first FROM a JOIN e USING (id)"))
def shard_rows(spark, sf_dir):
    b = base(spark, sf_dir)
    return clusters.to_shards(b, centers(b), 2).select("shard", F.col("id").alias("vec_id"), r6(F.get("vec", F.lit(0)).cast("double")).alias("first"))


@query(centers_sql(1, ", x AS (SELECT center, vec, unnest(range(0, len(vec))) AS pos FROM a JOIN e USING (id)) SELECT center, pos, round(avg(vec[pos + 1]::DOUBLE), 6) AS value FROM x GROUP BY ALL"))
def lloyd_iteration(spark, sf_dir):
    b = base(spark, sf_dir)
    numbers, points, _ = clusters.lloyd_iteration(b, centers(b), strict=True)
    rows = [(int(c), [float(x) for x in p]) for c, p in zip(numbers, points, strict=True)]
    out = spark.createDataFrame(rows, "center long, v array<double>").select("center", F.posexplode("v").alias("pos", "value"))
    return out.select("center", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query(centers_sql(1, "SELECT round(sum(d), 6) AS residual FROM a"))
def kmeans_residual(spark, sf_dir):
    b = base(spark, sf_dir)
    return clusters.nearest_centers(b, centers(b)).agg(r6(F.sum("dist")).alias("residual"))


# product quantisation

PIVOTS_SQL = f"""{E_SQL}, {Q_SQL}, {MEAN_SQL},
p AS (SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY qid) - 1 AS code, list_transform(list_zip(qvec[8 * chunk + 1:8 * chunk + 8], c[8 * chunk + 1:8 * chunk + 8]), lambda z: z[1]::DOUBLE - z[2]) AS piv
      FROM q, m, (SELECT unnest(range(0, 8)) AS chunk) WHERE qid < {STEP * pq.PIVOTS}),
v AS (SELECT id, chunk, list_transform(list_zip(vec[8 * chunk + 1:8 * chunk + 8], c[8 * chunk + 1:8 * chunk + 8]), lambda z: z[1]::DOUBLE - z[2]) AS part FROM e, m, (SELECT unnest(range(0, 8)) AS chunk)),
c AS (SELECT id, v.chunk, min_by(code, {{'d': {l2('part', 'piv')}, 'c': code}}) AS code FROM v JOIN p USING (chunk) GROUP BY id, v.chunk),
t AS (SELECT id AS qid, v.chunk, code, {l2('part', 'piv')} AS d FROM v JOIN p USING (chunk) WHERE id % {STEP} = 0),
a AS (SELECT qid, id, sum(d) AS dist FROM t JOIN c USING (chunk, code) GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank FROM a)"""


@query(f"WITH {PIVOTS_SQL} SELECT id AS vec_id, chunk, CAST(code AS BIGINT) AS code FROM c")
def pq_encode(spark, sf_dir):
    b = base(spark, sf_dir)
    codes = pq.encode(b, model(b))
    return codes.select(F.col("id").alias("vec_id"), F.posexplode("codes").alias("chunk", "code")).select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"))


@query(f"WITH {PIVOTS_SQL} SELECT qid, chunk, CAST(code AS BIGINT) AS code, round(d, 6) AS d FROM t")
def pq_lut(spark, sf_dir):
    b = base(spark, sf_dir)
    return pq.tables(asked(b), model(b)).select("qid", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"), r6("d").alias("d"))


@query(f"WITH {PIVOTS_SQL} SELECT qid, round(sum(dist), 5) AS total, count(*) AS n FROM r WHERE rank <= {TOP} GROUP BY qid")
def pq_adc_topl(spark, sf_dir):
    b = base(spark, sf_dir)
    m = model(b)
    return pq.adc_top(pq.encode(b, m), asked(b), m, TOP).groupBy("qid").agg(F.round(F.sum("dist"), 5).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {PIVOTS_SQL}, y AS (SELECT x.id AS a, z.id AS b, x.chunk, x.code AS ca, z.code AS cb FROM c x JOIN c z ON z.id = x.id + 1 AND x.chunk = z.chunk)
SELECT a, b, round(sum({l2('g.piv', 'h.piv')}), 6) AS dist FROM y JOIN p g ON g.chunk = y.chunk AND g.code = ca JOIN p h ON h.chunk = y.chunk AND h.code = cb GROUP BY a, b"""
)
def pq_symmetric(spark, sf_dir):
    b = base(spark, sf_dir)
    m = model(b)
    pairs = b.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return pq.symmetric_distance(pairs, pq.encode(b, m), m).select("a", "b", r6("dist").alias("dist"))


TWO_PHASE = f"""WITH {PIVOTS_SQL}, f AS (SELECT qid, id, {l2("qvec", "vec")} AS dist FROM r JOIN e USING (id) JOIN q USING (qid) WHERE rank <= {TOP}),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM f)"""


def _two_phase(b: DataFrame) -> DataFrame:
    m = model(b)
    return pq.two_phase_knn(b, pq.encode(b, m), asked(b), m, K, TOP)


@query(f"{TWO_PHASE} SELECT qid, rank, id AS vec_id, round(dist, 6) AS dist FROM n WHERE rank <= {K}")
def pq_two_phase_knn(spark, sf_dir):
    return shown(_two_phase(base(spark, sf_dir)))


TRUTH = f"x AS (SELECT qid, id, {l2('qvec', 'vec')} AS dist FROM q, e), xr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM x)"


@query(
    f"""{TWO_PHASE}, {TRUTH}, kth AS (SELECT qid, max(dist) AS kth FROM xr WHERE rank <= {K} GROUP BY qid), h AS (SELECT n.qid, n.id FROM n JOIN xr USING (qid, id) JOIN kth USING (qid) WHERE n.rank <= {K} AND xr.dist <= kth)
SELECT (SELECT count(*) FROM q) AS n_queries, count(*) AS hits, round(100.0 * count(*) / ((SELECT count(*) FROM q) * {K}), 6) AS recall FROM h"""
)
def recall_two_phase(spark, sf_dir):
    b = base(spark, sf_dir)
    truth = knn.exact_knn(b, asked(b), TOP)
    return stats.recall(_two_phase(b), truth, K).select("n_queries", "hits", r6("recall").alias("recall"))


@query(
    f"""WITH {E_SQL}, {Q_SQL}, {TRUTH}, l AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM xr WHERE rank <= {TOP} AND id % 10 <> 3),
kth AS (SELECT qid, max(dist) AS kth FROM l WHERE rank <= {K} GROUP BY qid), h AS (SELECT xr.qid, xr.id FROM xr JOIN l USING (qid, id) JOIN kth USING (qid) WHERE xr.rank <= {K} AND l.dist <= kth)
SELECT (SELECT count(DISTINCT qid) FROM l) AS n_queries, count(*) AS hits, round(100.0 * count(*) / ((SELECT count(*) FROM q) * {K}), 6) AS recall FROM h"""
)
def recall_active(spark, sf_dir):
    b = base(spark, sf_dir)
    truth = knn.exact_knn(b, asked(b), TOP)
    left = tags(b).join(deleted(b), "id", "left_anti")
    return stats.recall_active(truth.filter(F.col("rank") <= K), truth, left, K).select("n_queries", "hits", r6("recall").alias("recall"))


# graphs

EDGES_SQL = f"""{E_SQL}, s AS (SELECT a.id AS src, b.id AS dst, {l2('a.vec', 'b.vec')} AS dist FROM e a, e b WHERE a.id <> b.id),
g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM s QUALIFY rank <= {NEIGHBOURS})"""


def edges(b: DataFrame) -> DataFrame:
    return graphs.knn_graph(b, NEIGHBOURS)


def joined(graph: DataFrame) -> DataFrame:
    """(vec_id, nbrs) with the neighbours as text."""
    return graph.select(F.col("id").alias("vec_id"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_graph_edges(spark, sf_dir):
    return edges(base(spark, sf_dir)).withColumn("dist", r6("dist"))


@query(f"WITH {EDGES_SQL}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), n AS (SELECT src, count(*) AS deg FROM u GROUP BY src) SELECT max(deg) AS max_degree, round(avg(deg), 6) AS avg_degree, min(deg) AS min_degree, count(*) FILTER (WHERE deg < 2) AS n_under_2 FROM n")
def degree_stats(spark, sf_dir):
    return stats.degree_stats(graphs.adjacency(graphs.reverse_edges(edges(base(spark, sf_dir))))).withColumn("avg_degree", r6("avg_degree"))


@query(f"WITH {EDGES_SQL} SELECT dst AS vec_id, count(*) AS in_degree FROM g GROUP BY dst")
def in_degree(spark, sf_dir):
    return stats.in_degree(edges(base(spark, sf_dir))).select(F.col("id").alias("vec_id"), "in_degree")


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM g UNION SELECT dst, src FROM g")
def reverse_edges(spark, sf_dir):
    return graphs.reverse_edges(edges(base(spark, sf_dir)))


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM g WHERE dst % 10 = 3")
def dangling_edges(spark, sf_dir):
    b = base(spark, sf_dir)
    return stats.dangling_edges(edges(b), deleted(b))


@query(
    f"""WITH {EDGES_SQL}, d AS (SELECT src, dst AS dead FROM g WHERE src % 10 <> 3 AND dst % 10 = 3),
u AS (SELECT src, dst FROM g WHERE src IN (SELECT src FROM d) UNION SELECT d.src, g.dst FROM d JOIN g ON g.src = dead)
SELECT src, dst FROM u WHERE src <> dst AND dst % 10 <> 3"""
)
def delete_expand_candidates(spark, sf_dir):
    b = base(spark, sf_dir)
    return mutations.expand_candidates(edges(b), deleted(b))


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE vec_id % 10 <> 3")
def compact_ids(spark, sf_dir):
    b = base(spark, sf_dir)
    return mutations.compact_ids(b.join(deleted(b), "id", "left_anti")).select(F.col("id").alias("vec_id"), "new_id")


@query(
    f"""WITH {EDGES_SQL}, w AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE vec_id % 10 <> 3)
SELECT a.new_id AS src, b.new_id AS dst FROM g JOIN w a ON src = a.vec_id JOIN w b ON dst = b.vec_id"""
)
def compact_graph(spark, sf_dir):
    b = base(spark, sf_dir)
    nodes = b.join(graphs.adjacency(edges(b)), "id").join(deleted(b), "id", "left_anti")
    return graphs.edge_list(mutations.compact(nodes))


@query(
    f"""WITH {E_SQL}, {Q_SQL}, s AS (SELECT id, qid AS center, {l2("vec", "qvec")} AS d FROM q, e WHERE qid < {STEP * CENTERS}), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, center) AS rank FROM s QUALIFY rank <= 2),
z AS (SELECT center, id, vec FROM a JOIN e USING (id)), x AS (SELECT u.center, u.id AS src, w.id AS dst, {l2("u.vec", "w.vec")} AS dist FROM z u JOIN z w ON u.center = w.center AND u.id <> w.id),
g AS (SELECT *, row_number() OVER (PARTITION BY center, src ORDER BY dist, dst) AS rank FROM x QUALIFY rank <= {NEIGHBOURS}), o AS (SELECT src, dst, min(dist) AS dist FROM g GROUP BY src, dst),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM o QUALIFY rank <= {NEIGHBOURS}) SELECT src AS vec_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rank) AS nbrs FROM k GROUP BY src"""
)
def merge_shard_edges(spark, sf_dir):
    b = base(spark, sf_dir)
    return joined(graphs.merge_shards(graphs.shard_graph(clusters.to_shards(b, centers(b), 2), NEIGHBOURS), NEIGHBOURS))


@query(f"SELECT vec_id, vec_id // {PER_PAGE} AS page, vec_id % {PER_PAGE} AS slot FROM embeddings")
def page_layout(spark, sf_dir):
    return layout.page_layout(base(spark, sf_dir), PER_PAGE).select(F.col("id").alias("vec_id"), "page", "slot")


@query(f"SELECT vec_id // {PER_PAGE} AS page, vec_id FROM embeddings WHERE vec_id // {PER_PAGE} IN (SELECT vec_id // {PER_PAGE} FROM embeddings WHERE vec_id % {STEP} = 0)")
def page_expand(spark, sf_dir):
    b = base(spark, sf_dir)
    pages = layout.page_layout(b, PER_PAGE)
    return layout.expand_pages(pages, asked(b).select(F.col("qid").alias("id"))).select("page", F.col("id").alias("vec_id"))


@query(
    """WITH t AS (SELECT vec_id AS loc, vec_id * 7 + 3 AS tag FROM embeddings), p AS (SELECT loc // 7 AS page, loc % 7 AS slot, tag FROM t)
SELECT page, string_agg(CAST(tag AS VARCHAR), ',' ORDER BY slot) || repeat(',4294967295', CAST(7 - count(*) AS INTEGER)) AS ids FROM p GROUP BY page"""
)
def page_padded(spark, sf_dir):
    t = tags(base(spark, sf_dir)).select(F.col("id").alias("loc"), "tag")
    return layout.pad_pages(layout.tags_to_pages(t, 7), 7).select("page", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {EDGES_SQL} SELECT src // {PER_PAGE} AS page, src % {PER_PAGE} AS slot, src AS vec_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs FROM g GROUP BY src")
def disk_layout(spark, sf_dir):
    b = base(spark, sf_dir)
    made = layout.create_layout(b, graphs.adjacency(edges(b)), PER_PAGE, NEIGHBOURS)
    return made.select("page", "slot", F.col("id").alias("vec_id"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query(
    """WITH t AS (SELECT vec_id AS loc, CASE WHEN vec_id % 50 = 7 THEN 2147483647 ELSE vec_id * 7 + 3 END AS tag FROM embeddings), h AS (SELECT vec_id AS head, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings WHERE vec_id % 50 = 0),
o AS (SELECT loc, row_number() OVER (ORDER BY loc) AS k FROM t WHERE tag = 2147483647) SELECT loc, coalesce(head, tag) AS tag FROM t LEFT JOIN o USING (loc) LEFT JOIN h USING (k)"""
)
def fill_tag_holes(spark, sf_dir):
    b = base(spark, sf_dir)
    t = b.select(F.col("id").alias("loc"), F.when(F.col("id") % 50 == 7, F.lit(2147483647)).otherwise(F.col("id") * 7 + 3).alias("tag"))
    return layout.fill_holes(t, asked(b).select(F.col("qid").alias("id")))


# statistics


@query("SELECT event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY event_type")
def stats_mean(spark, sf_dir):
    return stats.mean_stat(table(spark, sf_dir, "events"), "value", "event_type").withColumn("mean_value", r6("mean_value"))


@query(
    """WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, p, v[CAST(least(floor(p * len(v)), len(v) - 1) AS BIGINT) + 1] AS value FROM s, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.999::DOUBLE]) AS p)"""
)
def stats_percentile_floor(spark, sf_dir):
    return stats.percentile_floor(table(spark, sf_dir, "events"), "value", [0.5, 0.9, 0.999], "event_type")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return mutations.upsert_latest(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(
    """WITH h AS (SELECT vec_id, c, (((vec_id % 1073741824) + 7919 * (c + 1)) * 2654435761) % 4294967296 / 4294967296.0 AS h FROM embeddings, (SELECT unnest([0, 1]) AS c))
SELECT CAST(c AS INTEGER) AS cycle, CASE WHEN h < 0.1 THEN 'delete' ELSE 'insert' END AS op, vec_id AS id FROM h WHERE h < 0.2"""
)
def churn_workload(spark, sf_dir):
    return mutations.churn(base(spark, sf_dir), 2, 0.1, 0.1)


@query(unnested("vec", "round(v[i + 1]::DOUBLE, 6)"))
def tsv_roundtrip(spark, sf_dir):
    out = long_form(text.parse_tsv(text.format_tsv(base(spark, sf_dir)), 64), F.col("vec"))
    return out.withColumn("val", r6(F.col("val").cast("double")))


# graph search

def nodes(b: DataFrame) -> DataFrame:
    """Shards of consecutive ids, each with its own neighbour graph made symmetric."""
    shards = b.withColumn("shard", F.floor(F.col("id") / SHARD_ROWS).cast("long"))
    near = graphs.shard_graph(shards, NEIGHBOURS)
    both = near.select("shard", "src", "dst").union(near.select("shard", F.col("dst").alias("src"), F.col("src").alias("dst")))
    lists = both.groupBy("shard", F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
    return shards.join(lists, ["shard", "id"], "left").select("shard", "id", "vec", F.coalesce("nbrs", F.expr("cast(array() as array<bigint>)")).alias("nbrs"), F.floor(F.col("id") / PER_PAGE).alias("page"))


#: A pool that holds a whole shard.
FULL = SHARD_ROWS


@query(EXACT)
def graph_beam_full(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(graphs.search_graph(nodes(b), asked(b), K, FULL, 8, "beam"))


@query(EXACT)
def graph_page_full(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(graphs.search_graph(nodes(b), asked(b), K, FULL, 8, "page"))


@query(EXACT)
def graph_pipe_full(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(graphs.search_graph(nodes(b), asked(b), K, FULL, 16, "pipe"))


@query(EXACT)
def graph_batch_full(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(graphs.search_graph(nodes(b), asked(b), K, FULL, 8, "batch"))


@query(knn_sql(l2("qvec", "vec"), "id % 10 <> 3"))
def graph_deleted_full(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(graphs.search_graph(nodes(b), asked(b), K, FULL, 8, "batch", deleted=deleted(b)))


# built graphs and bounded pools; results that aren't exact are held against a bound on their recall

DEGREE, POOL, CODE_CHUNKS = 32, 64, 32


def placed(b: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    """(shard, id, vec) for building, and the shards' centers; one shard as long as that holds all rows."""
    shards = -(-b.count() // SHARD_ROWS)
    if shards < 2:
        return b.select(F.lit(0).cast("long").alias("shard"), "id", "vec"), None
    return clusters.partition(b, shards, 2)


def built(b: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    rows, own = placed(b)
    return cut(graphs.build_graph(rows, DEGREE, POOL)), own


def bound_sql(bounds: dict[str, int]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS search, {least} AS least" for name, least in bounds.items())
    return f"SELECT search, (SELECT count(*) FROM embeddings WHERE vec_id % {STEP} = 0) AS n_queries, least, true AS reached FROM ({rows})"


def bounded(b: DataFrame, found: dict[str, DataFrame], bounds: dict[str, int], truth: DataFrame | None = None) -> DataFrame:
    """(search, n_queries, least, reached): whether the recall of each search, in percent, is at least what it should be."""
    truth = cut(knn.exact_knn(b, asked(b), TOP)) if truth is None else truth
    parts = [stats.recall(df, truth, K).select(F.lit(name).alias("search"), "n_queries", F.lit(bounds[name]).alias("least"), (F.col("recall") >= bounds[name]).alias("reached")) for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


POOLS = {"L10": 65, "L20": 85, "L40": 92, "L100": 97}


def pooled(b: DataFrame) -> dict[str, DataFrame]:
    """Searches by stored codes of a trained model, one for each size of the pool."""
    n, own = built(b)
    m = pq.train(b, CODE_CHUNKS)
    coded = cut(n.join(pq.encode(b, m), "id"))
    return {name: graphs.search_graph(coded, asked(b), K, int(name[1:]), 8, "pipe" if name == "L40" else "batch", m, centers=own) for name in POOLS}


@query(bound_sql(POOLS))
def graph_beam_recall(spark, sf_dir):
    b = base(spark, sf_dir)
    return bounded(b, pooled(b), POOLS)


#: Shards of the queries that route, their centers the first of the rows asked for.
SHARDS = 4


def sharded(b: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    rows = asked(b).orderBy("qid").limit(SHARDS).collect()
    own = (np.arange(len(rows)), np.array([r[1] for r in rows], np.float64))
    return cut(graphs.build_graph(clusters.to_shards(b, own, 2), DEGREE, POOL)), own


@query("SELECT vec_id, true AS bounded, 0 AS loops, true AS reached FROM embeddings, (SELECT unnest(range(0, 2)) AS copy)")
def vamana_edges(spark, sf_dir):
    """A row for each row of a shard: whether its list is bounded, how often it is in it, and whether the shard's medoid leads to it."""
    n, _ = sharded(base(spark, sf_dir))
    return graphs.reached(n).select(F.col("id").alias("vec_id"), (F.size("nbrs") <= DEGREE).alias("bounded"), F.size(F.filter("nbrs", lambda x: x == F.col("id"))).alias("loops"), "reached")


ROUTED = {"all shards": 95, "three shards": 90, "beam": 95, "static pipe": 95, "naive pipe": 95, "fast": 90, "own starts": 95}


@query(bound_sql(ROUTED))
def vamana_knn(spark, sf_dir):
    b = base(spark, sf_dir)
    n, own = sharded(b)
    starts = cut(graphs.sample_entries(b, asked(b), 0.05))
    q = asked(b)
    found = {
        "all shards": graphs.search_graph(n, q, K, 64, 4),
        "three shards": graphs.search_graph(n, q, K, 64, 4, centers=own, probes=3),
        "beam": graphs.search_graph(n, q, K, 64, 4, "beam"),
        "static pipe": graphs.search_graph(n, q, K, 64, 32, "pipe", policy="static"),
        "naive pipe": graphs.search_graph(n, q, K, 64, 16, "pipe", policy="naive"),
        "fast": graphs.search_graph(n, q, K, 64, 4, "fast"),
        "own starts": graphs.search_graph(n, q, K, 64, 4, "beam", starts=starts),
    }
    return bounded(b, found, ROUTED)


PRUNE_SQL = f"""WITH RECURSIVE {E_SQL}, s AS (SELECT a.id AS src, b.id AS dst, {l2('a.vec', 'b.vec')} AS dist FROM e a, e b WHERE a.id <> b.id),
c AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM s QUALIFY rank <= 32),
sh AS (SELECT i.src, i.rank, any_value(i.dst) AS dst, list(j.dst) FILTER (WHERE i.dist > x.dist) AS one, list(j.dst) FILTER (WHERE i.dist > 1.2 * x.dist) AS alpha
  FROM c i JOIN c j ON i.src = j.src AND j.rank < i.rank JOIN s x ON x.src = j.dst AND x.dst = i.dst GROUP BY i.src, i.rank
  UNION ALL SELECT src, rank, dst, NULL, NULL FROM c WHERE rank = 1),
p AS (SELECT DISTINCT src, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept FROM c
  UNION ALL SELECT p.src, step + 1, CASE WHEN len(kept) < {NEIGHBOURS} AND NOT list_contains(kept, sh.dst)
    AND NOT list_has_any(kept, coalesce(CASE WHEN step < 32 THEN one ELSE alpha END, CAST([] AS BIGINT[]))) THEN list_append(kept, sh.dst) ELSE kept END
  FROM p JOIN sh ON sh.src = p.src AND sh.rank = p.step % 32 + 1 WHERE step < 64),
f AS (SELECT p.src, kept, list(dst ORDER BY rank) FILTER (WHERE NOT list_contains(kept, dst)) AS rest FROM p JOIN c USING (src) WHERE step = 64 GROUP BY p.src, kept)
SELECT src AS vec_id, list_aggregate(list_transform(list_sort(list_concat(kept, coalesce(rest, CAST([] AS BIGINT[]))[1:{NEIGHBOURS} - len(kept)])), lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS nbrs FROM f"""


@query(PRUNE_SQL)
def robust_prune(spark, sf_dir):
    b = base(spark, sf_dir)
    wide = graphs.knn_graph(b, 32)
    full = wide.select(F.col("src").alias("id"), F.col("dst").alias("cand")).join(b.select(F.col("id").alias("cand"), F.col("vec").alias("cvec")), "cand").join(b, "id")  # grouped by id as joined
    return joined(graphs.prune_groups(full, NEIGHBOURS).withColumn("nbrs", F.sort_array("nbrs")))


@query("SELECT vec_id, CAST(0 AS BIGINT) AS n_dead, true AS bounded FROM embeddings WHERE vec_id % 10 <> 3")
def consolidate_deletes(spark, sf_dir):
    """What holds for the lists after consolidation: no deleted row in them; those rebuilt are bounded, others as they were."""
    b = base(spark, sf_dir)
    before = cut(nodes(b))
    after = mutations.consolidate(before, deleted(b), 16)
    dead = F.filter("nbrs", lambda x: x % 10 == 3)
    old = before.select("shard", "id", F.col("nbrs").alias("old"))
    return after.join(old, ["shard", "id"]).select(F.col("id").alias("vec_id"), F.size(dead).cast("long").alias("n_dead"), ((F.size("nbrs") <= 16) | (F.col("nbrs") == F.col("old"))).alias("bounded"))


INSERTED = {"inserted": 95, "consolidated": 95}


@query(bound_sql({"inserted": 95}) + " UNION ALL " + bound_sql({"consolidated": 95}))
def insert_points(spark, sf_dir):
    """Recall after the rows asked for were inserted, and after other rows were inserted, deleted and taken out of the lists.

    A new row's place is looked for in the two shards of the nearest means, however many there are: the searches go to all.
    """
    b = base(spark, sf_dir)
    q = asked(b)
    first = cut(graphs.build_graph(b.filter(F.col("id") % STEP != 0).select(F.floor(F.col("id") / SHARD_ROWS).cast("long").alias("shard"), "id", "vec"), DEGREE, POOL))
    own = clusters.shard_centers(first)
    grown = cut(mutations.insert(first, b.filter(F.col("id") % STEP == 0), DEGREE, POOL, centers=own))
    more = b.filter(F.col("id") % 10 == 3).select((-F.col("id") - 1).alias("id"), "vec")
    whole = cut(mutations.insert(grown, more, DEGREE, POOL, centers=own))
    shrunk = cut(mutations.consolidate(whole, more, DEGREE))
    return bounded(b, {"inserted": graphs.search_graph(grown, q, K, 64, 4), "consolidated": graphs.search_graph(shrunk, q, K, 64, 4)}, INSERTED)

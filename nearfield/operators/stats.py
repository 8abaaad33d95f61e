"""Aggregates over vectors, graphs and results: centroid, medoid, degrees, recall and floor percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2sq


def centroid_long(vectors: DataFrame) -> DataFrame:
    """(pos, value): the mean of each dimension; partial sums are combined before the shuffle."""
    return vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid(vectors: DataFrame) -> DataFrame:
    """One row with the mean vector; it has a dimension's worth of values, whatever the number of rows."""
    return centroid_long(vectors).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("center"))


def medoid(vectors: DataFrame) -> DataFrame:
    """(id, dist): the row nearest to the mean, the lowest id among equals."""
    scored = vectors.crossJoin(F.broadcast(centroid(vectors))).select("id", l2sq(F.col("vec"), F.col("center")).alias("dist"))
    return scored.agg(F.min(F.struct("dist", "id")).alias("m")).select("m.id", "m.dist")


def degree_stats(graph: DataFrame) -> DataFrame:
    """Greatest, mean and least out-degree of (id, nbrs), and how many nodes have fewer than two neighbours."""
    degree = F.size("nbrs")
    return graph.agg(F.max(degree).cast("long").alias("max_degree"), F.avg(degree).alias("avg_degree"), F.min(degree).cast("long").alias("min_degree"), F.count_if(degree < 2).alias("n_under_2"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def dangling_edges(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges that lead to deleted nodes."""
    return edges.join(deleted.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share in percent of true neighbours found; truth beyond rank ``k`` counts while it ties with it."""
    w = Window.partitionBy("qid")
    ties = truth.withColumn("_kth", F.max(F.when(F.col("rank") <= k, F.col("dist"))).over(w)).filter("dist <= _kth").select("qid", "id")
    return _share(results, ties, truth, k)


def recall_active(results: DataFrame, truth: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """Recall against the first ``k`` true neighbours that are live, and those that tie with the last of them."""
    live = truth.join(tags.select("id").distinct(), "id", "left_semi")
    ranked = live.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return recall(results, ranked, k)


def _share(results: DataFrame, ties: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    first = results.filter(F.col("rank") <= k).select("qid", "id").distinct()
    hits = first.join(ties, ["qid", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    queries = truth.agg(F.countDistinct("qid").alias("n_queries"))
    return hits.crossJoin(queries).select("n_queries", "hits", F.try_divide(100.0 * F.col("hits"), F.col("n_queries") * k).alias("recall"))


def percentile_floor(df: DataFrame, value: str, ps: list[float], by: str | None = None) -> DataFrame:
    """(by, p, value): element floor(p * n) of the sorted values of each group, without interpolation.

    The values are counted per distinct value and ranked by running sums over those counts, so that the window holds
    distinct values, not rows.
    """
    keys = [by] if by else []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    placed = counted.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    asked = placed.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    at = F.least(F.floor(F.col("p") * F.col("_all")), F.col("_all") - 1)
    return asked.filter((at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto"))).select(*keys, "p", F.col(value).alias("value"))


def mean_stat(df: DataFrame, value: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def visit_counts(expanded: DataFrame) -> DataFrame:
    """How often each node was expanded."""
    return expanded.groupBy("id").agg(F.count(F.lit(1)).alias("visits"))

"""The index as a whole: routed search over stored buckets, changes, and what the driver may see."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import clusters, filters, graphs, knn, mutations, pq
from nearfield.plans import index


@pytest.fixture(scope="module")
def base(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vec")
    return df.filter("id < 1200").cache()


def asked(df):
    return df.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def share(found, want):
    want = {(r.qid, r.id) for r in want.collect()}
    return len({(r.qid, r.id) for r in found.collect()} & want) / len(want)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_search_routes_queries_and_leaves_the_nodes_in_place(spark, base, tmp_path, metric):
    made = index.build(base, f"{tmp_path}/i", index.Parameters(metric=metric, shard_rows=400, chunks=32))
    made = index.Index.open(spark, f"{tmp_path}/i")
    q, truth = asked(base), knn.exact_knn(base, asked(base), 10, metric)
    assert made.shards == 3 and share(made.search(q, 10, 40), truth) > 0.95
    assert share(made.search(q, 10, 40, use_codes=True), truth) > 0.95
    assert share(made.search(q, 10, 40, use_codes=True, probes=2), truth) > 0.75
    assert share(made.search(q, 10, 40, "page"), truth) > 0.95
    plan = made.search(q, 10, 40, use_codes=True, probes=2)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("Scan parquet spark_catalog") - 400 : plan.index("Scan parquet spark_catalog")]
    assert "Bucketed: true" in plan and "Exchange" not in side
    work = made.search(q, 10, 40, mode="beam", stats=True).groupBy("qid").agg(F.sum("comparisons").alias("c"), F.sum("reads").alias("r")).collect()
    assert len(work) == 24 and all(0 < r.r <= r.c for r in work)


def test_changes_keep_the_recall(spark, base, tmp_path):
    p = index.Parameters(shard_rows=700, chunks=16, degree=32)
    made = index.build(base.filter("id >= 300"), f"{tmp_path}/i", p)
    made.insert(base.filter("id < 300").selectExpr("id", "id AS tag", "vec"))
    failed = made.delete(spark.createDataFrame([(t,) for t in [*range(600, 700), 10**6]], "tag long"))
    assert [r.tag for r in failed.collect()] == [10**6]
    left = base.filter("id < 600 OR id >= 700")
    truth = knn.exact_knn(left, asked(base), 10)
    fresh = index.build(left, f"{tmp_path}/fresh", p).search(asked(base), 10, 64)
    least = share(fresh, truth) - 0.01
    lazy = made.search(asked(base), 10, 64)
    assert not {r.id for r in lazy.collect()} & set(range(600, 700)) and share(lazy, truth) >= least
    made.consolidate()
    made = index.Index.open(spark, f"{tmp_path}/i")
    assert made.rows == 1100 and made.table("deleted").count() == 0 and share(made.search(asked(base), 10, 64), truth) >= least
    assert made.vector_of(600) is None and np.allclose(made.vector_of(5), base.filter("id = 5").first()["vec"])
    changes = [(1, "insert", 5000, 7, [0.5] * 64), (2, "delete", 1, 1, None), (3, "insert", 1, 1, [0.25] * 64), (4, "delete", 9, 9, None)]
    changed = spark.createDataFrame(changes, "seq long, op string, id long, tag long, vec array<float>")
    changed.write.parquet(f"{tmp_path}/changes")
    stream = spark.readStream.schema(changed.schema).parquet(f"{tmp_path}/changes")
    index.follow(stream, made, f"{tmp_path}/mark").awaitTermination()
    assert made.vector_of(7) == [0.5] * 64 and made.vector_of(1) == [0.25] * 64 and made.vector_of(9) is None
    assert made.search(spark.createDataFrame([(0, [0.5] * 64)], "qid long, qvec array<float>"), 1, 30).first()["id"] == 5000
    made.delete(spark.createDataFrame([(7,)], "tag long"), eager=1)
    assert made.table("nodes").filter("id = 5000 OR array_contains(nbrs, 5000)").count() == 0
    made.clear()
    assert made.rows == 0 and made.search(asked(base), 10, 64).count() == 0


def test_the_driver_sees_no_base_row(spark, base, monkeypatch):
    """More rows than a block: the neighbour graph and inserts collect nothing that has a vector in it."""
    monkeypatch.setattr(knn, "CELL_ROWS", 200)
    centers = clusters.seed_random(base, 5)
    want = {(r.qid, r.id, r["rank"]) for r in knn.top_k(knn.exact_knn(base, base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 6, block=500).filter("qid <> id").drop("rank"), 5).collect()}
    nodes = graphs.build_graph(base.filter("id >= 100").select((F.col("id") % 2).alias("shard"), "id", "vec"), 16, 32)
    collect = DataFrame.collect

    def guarded(df):
        assert not {"vec", "qvec", "embedding"} & set(df.columns), df.columns
        return collect(df)

    monkeypatch.setattr(DataFrame, "collect", guarded)
    found = knn.knn_all(base, 5, centers)
    assert mutations.insert(nodes, base.filter("id < 100"), 16, 32).select("id").distinct().count() == 1200
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == want


def test_clustered_rows_go_to_few_cells(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) + 100 * (i % 6)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    x = np.array([v for _, v in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    centers = (np.arange(6), x[:6])
    got = {(r.qid, r.id) for r in knn.knn_all(df, 3, centers).collect()}
    assert got == {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(600), d[i]))[:3]}


def test_exact_far_from_the_origin(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) + 1e6
    q, i, d = knn.nearest("l2", np.arange(20), x[:20], np.arange(3000), x, 10)
    want = np.concatenate([np.lexsort((np.arange(3000), ((x - a) ** 2).sum(1)))[:10] for a in x[:20]])
    assert (i == want).all()


def test_batch_is_beam_in_step():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    s = graphs.build_shard(np.arange(400), x, 12, 30)
    q = rng.normal(size=(30, 8))
    gone = np.arange(400) % 3 == 0
    for deleted in (None, gone):
        for rounds in (None, 3):
            a, b = graphs.Stats(), graphs.Stats()
            one = [graphs.search_shard(s, v, 5, 20, 4, deleted=deleted, max_rounds=rounds, stats=a) for v in q]
            many = graphs.search_batch(s, q, 5, 20, 4, deleted=deleted, max_rounds=rounds, stats=b)
            assert all((u[0] == w[0]).all() and np.allclose(u[1], w[1]) for u, w in zip(one, many, strict=True))
            assert (a.hops, a.reads, a.comparisons) == (b.hops, b.reads, b.comparisons)


def test_every_part_of_a_graph_is_entered():
    s = graphs.Shard(np.arange(9), np.arange(9.0)[:, None], [np.array(x) for x in ([1], [0], [3], [2], [5], [4], [7], [6], [])], entries=[0])
    s.nbrs[8] = np.empty(0, np.int64)
    s.cover()
    assert s.entries == [0, 2, 4, 6, 8]


def test_pipe_policies_and_cut_off():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    s = graphs.build_shard(np.arange(300), x, 12, 30)
    for policy in ("adaptive", "static", "naive"):
        at, _ = graphs.search_shard(s, x[7], 1, 30, 32, "pipe", policy=policy)
        assert at[0] == 7
    at, _ = graphs.search_shard(s, x[7], 5, 30, mode="fast")
    assert at[0] == 7 and len(at) == 5
    assert len(graphs.search_shard(s, x[7], 5, 30, deadline=-1.0)[0]) == 0


def brute_prune(dist, among, degree, alpha):
    """The rule as it is stated: by factor, the first candidate no taken one before it shades by more."""
    taken = []
    factor = 1.0
    while factor <= alpha + 1e-9:
        for i in range(len(dist)):
            shades = [dist[i] / among[j][i] if among[j][i] > 0 else np.inf for j in taken if j < i]
            if i not in taken and len(taken) < degree and all(x <= factor for x in shades):
                taken.append(i)
        factor *= 1.2
    return taken


def test_pruning_against_brute_force():
    rng = np.random.default_rng(3)
    for k in range(60):
        x = rng.normal(size=(int(rng.integers(1, 40)), 3))
        if k % 5 == 0:
            x = np.round(x)
        d = (x**2).sum(1)
        x, d = x[np.argsort(d, kind="stable")], np.sort(d, kind="stable")
        among = ((x[:, None] - x[None]) ** 2).sum(2)
        assert graphs.robust_prune(d, among, 8, 1.2) == brute_prune(d, among, 8, 1.2)


def test_frozen_point_and_residuals(spark, base):
    nodes = graphs.build_graph(base.filter("id < 200").select(F.lit(0).alias("shard"), "id", "vec"), 8, 16)
    frozen = mutations.frozen_point(nodes, -1)
    row = frozen.filter("frozen").first()
    assert row.id == -1 and frozen.count() == 201 and len(row.nbrs) > 0
    hidden = frozen.filter("frozen").select("id")
    found = graphs.search_graph(frozen, asked(base), 5, 40, deleted=hidden, entries=frozen.filter("frozen"))
    assert found.filter("id = -1").count() == 0 and found.groupBy("qid").count().filter("count <> 5").count() == 0
    centers = spark.createDataFrame([(0, [0.5] * 64), (1, [-0.5] * 64)], "center long, cvec array<double>")
    near = clusters.nearest_centers(base, clusters.fetch_centers(centers))
    there = pq.residuals(base, near, centers)
    back = {r.id: r.vec for r in pq.residuals(there, near, centers, back=True).collect()}
    assert all(np.allclose(back[r.id], r.vec, atol=1e-6) for r in base.collect())
    turn = pq.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    turned = {r.id: r.vec for r in pq.rotate(pq.rotate(base, turn), turn, back=True).collect()}
    assert all(np.allclose(turned[r.id], r.vec, atol=1e-6) for r in base.collect())


def test_far_ids_are_numbered_in_even_ranges(spark):
    df = spark.range(5000).selectExpr("if(id = 0, 1000000000000000, id) AS id")
    got = {r.id: r.new_id for r in mutations.compact_ids(df, 300).collect()}
    assert got == {v: k for k, v in enumerate(sorted(got))} and len(got) == 5000


def test_row_range_past_the_end(spark):
    df = spark.range(10)
    assert filters.row_range(df, 4, 3).count() == 3
    with pytest.raises(ValueError):
        filters.row_range(df, 8, 3)

"""Cases in which a vector operator once did less than the whole job."""

import numpy as np

from nearfield.operators import graphs, knn, mutations
from nearfield.plans import catalog


def test_new_copies_near_a_hub_are_found(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(60, 4)).astype(float)
    vecs[0] = 0
    rows = [(0, i, vecs[i].tolist(), list(range(1, 60)) if i == 0 else [0]) for i in range(60)]
    nodes = spark.createDataFrame(rows, "shard long, id long, vec array<float>, nbrs array<long>")
    new = spark.createDataFrame([(1000 + i, [0.01, 0.0, 0.0, 0.0]) for i in range(100)], "id long, vec array<float>")
    out = mutations.insert(nodes, new, 4, 16).cache()
    assert out.count() == 160
    queries = spark.createDataFrame([(1, [0.01, 0.0, 0.0, 0.0])], "qid long, qvec array<float>")
    found = {r.id for r in graphs.search_graph(out, queries, 160, 400).collect()}
    assert found == {*range(60), *range(1000, 1100)}


def test_a_full_pool_is_followed_once_for_all_queries():
    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(90, 3)))  # with ties and equal rows
    nbrs = [np.unique(rng.integers(0, 60, 2)) if i < 60 else np.array([60 + (i + 1) % 30]) for i in range(90)]
    shard = graphs.Shard(np.arange(90, dtype=np.int64) * 2, vecs, nbrs, pages=np.arange(90) // 7)
    gone = rng.random(90) < 0.3
    queries = vecs[:20]
    for own in ([None] * 20, [[3, 70] if i % 2 else [61] for i in range(20)]):
        for mode, dead in (("beam", None), ("page", gone), ("pipe", gone)):
            at_once = graphs.exhaust(shard, queries, 7, own, dead, mode == "page")
            for q, starts, (place, d) in zip(queries, own, at_once, strict=True):
                want, far = graphs.search_shard(shard, q, 7, 90, 4, mode, starts=starts, deleted=dead)
                assert place.tolist() == want.tolist() and np.allclose(d, far)


def test_the_plan_joins_blocks(spark):
    base = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "id long, vec array<float>")
    asked = base.selectExpr("id AS qid", "vec AS qvec").filter("qid % 7 = 0")
    found = knn.knn_plan(base, asked, 2, block=2)
    assert {(r.qid, r.id) for r in found.collect()} >= {(q, q) for q in range(0, 30, 7)}
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_settles_what_single_precision_leaves_open():
    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 0.0), (1.0, 1e4), (1e-22, 0.0), (1e19, 0.0)):
        x = (rng.normal(size=(3000, 16)) + shift) * scale
        x[100:400] = x[7]
        far = ((x[:40, None] - x[None]) ** 2).sum(2)
        want = [np.lexsort((np.arange(3000), d))[:5] for d in far]
        q, i, d = knn.nearest("l2", np.arange(40), x[:40], np.arange(3000), x, 5)
        assert i.tolist() == np.concatenate(want).tolist() and np.allclose(d, np.take_along_axis(far, np.array(want), 1).ravel())
        limits = np.array([np.nan, *np.sort(far, 1)[1:, 2]])
        q, i, d = knn.nearest("l2", np.arange(40), x[:40], np.arange(3000), x, 5, limits)
        assert all(set(w[:3].tolist()) <= set(i[q == n].tolist()) for n, w in enumerate(want))


def test_edges_are_found_once_and_held(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "id long, vec array<float>")
    edges = graphs.knn_graph(vectors, 2)
    assert "CoGroup" not in graphs.reverse_edges(edges)._jdf.queryExecution().executedPlan().toString()


def test_copies_are_reached_within_the_degree():
    vecs = np.repeat(np.random.default_rng(5).normal(size=(6, 8)), 50, 0)
    shard = graphs.build_shard(np.arange(300, dtype=np.int64), vecs, 8, 16)
    assert len(shard.closure(shard.entries)) == 300
    assert max(map(len, shard.nbrs)) <= 8 and all(i not in x and len(set(x.tolist())) == len(x) for i, x in enumerate(shard.nbrs))


def test_all_pairs_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_ROWS", 30)
    x = np.random.default_rng(6).normal(size=(200, 24))
    x[20:40] = x[3]
    rows = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = knn.knn_all(rows, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroup" not in plan  # not each row to every cell and back
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(7 * q, r + 1, 7 * int(i)) for q in range(200) for r, i in enumerate(np.lexsort((np.arange(200), d[q]))[:5])}
    assert {(r.qid, r.rank, r.id) for r in found.collect()} == want


def test_pairs_are_settled_for_both_sides():
    rng = np.random.default_rng(7)
    for scale, shift in ((1.0, 0.0), (1.0, 1e4), (1e-22, 0.0), (1e19, 0.0)):
        x = (np.round(rng.normal(size=(900, 16)), 1) + shift) * scale
        x[100:200] = x[7]
        ids = rng.permutation(900).astype(np.int64)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        limits = np.sort(d[:, :300], 1)[:, 4]
        limits[5] = np.nan
        a, b = slice(0, 400), slice(400, 900)
        found = [knn.both_ways((ids[s], ids[t]), (x[s], x[t]), (limits[s], limits[t]), 5, s == t) for s, t in ((a, b), (a, a), (b, b))]
        q, i, _ = knn.first_k(found, 5)
        assert i.reshape(-1, 5).tolist() == [ids[np.lexsort((ids, d[r]))[:5]].tolist() for r in np.argsort(ids)]


def test_many_copies_of_each_vector_are_no_hindrance(spark):
    vecs = np.random.default_rng(8).normal(size=(60, 32))
    rows = [(0, i, vecs[i % 60].tolist()) for i in range(60 * 40)]
    built = graphs.build_graph(spark.createDataFrame(rows, "shard long, id long, vec array<float>"), 8, 16).cache()
    assert built.filter("size(nbrs) > 8 OR array_contains(nbrs, id)").isEmpty()
    assert graphs.reached(built).filter("NOT reached").isEmpty()
    asked = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(60)], "qid long, qvec array<float>")
    gone = spark.createDataFrame([(i,) for i in range(60 * 3)], "id long")
    for mode in ("batch", "beam", "fast"):
        found = graphs.search_graph(built, asked, 10, 16, 4, mode, deleted=gone).collect()
        assert sorted((r.qid, r.rank, r.id) for r in found) == [(q, j + 1, q + 60 * (3 + j)) for q in range(60) for j in range(10)]


def test_new_points_are_searched_for_in_the_nearest_shards(spark, sf_dir, monkeypatch):
    seen = []
    real = graphs.search_graph

    def spied(*args, **how):
        seen.append(how.get("centers"))
        return real(*args, **how)

    monkeypatch.setattr(mutations, "search_graph", spied)
    assert all(r.reached for r in catalog.queries()["insert_points"](spark, sf_dir).collect())
    assert len(seen) == 2 and all(c is not None for c in seen)


def test_shards_are_built_in_tasks_of_their_own(spark):
    rows = spark.createDataFrame([(s, 10 * s + i, [float(i)]) for s in range(4) for i in range(5)], "shard long, id long, vec array<float>")
    assert "REPARTITION_BY_NUM" in graphs.build_graph(rows, 4, 8)._jdf.queryExecution().executedPlan().toString()

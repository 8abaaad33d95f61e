"""Small made-up cases: ties, duplicates, zero vectors, separate parts of a graph, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import clusters, filters, graphs, knn, layout, mutations, pq, stats
from nearfield.plans.index import Index, Parameters, build
from nearfield.sources import binary, text
from nearfield.streaming import changes


def line(spark, n=10):
    return spark.createDataFrame([(i, [float(i)]) for i in range(n)], "id long, vec array<float>")


def ask(spark, *values):
    return spark.createDataFrame([(k, [float(v)]) for k, v in enumerate(values)], "qid long, qvec array<float>")


def found(df):
    return [(r.qid, r["rank"], r.id, round(r.dist, 6)) for r in df.orderBy("qid", "rank").collect()]


def test_knn_ties_go_to_the_lower_id(spark):
    want = [(0, 1, 4, 0.0), (0, 2, 3, 1.0), (0, 3, 5, 1.0)]
    assert found(knn.exact_knn(line(spark), ask(spark, 4), 3)) == want
    assert found(knn.knn_plan(line(spark), ask(spark, 4), 3)) == want


def test_knn_of_few_rows_null_vectors_and_empty_tables(spark):
    few = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, vec array<float>")
    assert found(knn.exact_knn(few, ask(spark, 0), 5)) == [(0, 1, 1, 1.0)]
    assert found(knn.exact_knn(few.limit(0), ask(spark, 0), 5)) == []
    assert found(knn.exact_knn(few, ask(spark, 0).limit(0), 5)) == []


def test_knn_in_blocks_is_the_same(spark):
    q = ask(spark, 0.2, 3.4, 8.8, 5.5)
    assert found(knn.exact_knn(line(spark), q, 3, block=2)) == found(knn.exact_knn(line(spark), q, 3))


def test_knn_plan_in_blocks_is_the_same(spark):
    one = knn.knn_plan(line(spark), ask(spark, 1, 2, 3), 2).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, knn.knn_plan(line(spark), ask(spark, 1, 2, 3), 2, block=1).collect()))


def test_zero_vectors_and_unknown_metrics(spark):
    z = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<float>, b array<float>")
    r = z.select(V.normalize(F.col("a")), V.normalize(F.col("b")), V.cosine_distance(F.col("a"), F.col("b")), V.norm(F.col("b"))).first()
    assert list(r[0]) == [0.0, 0.0] and np.allclose(r[1], [0.6, 0.8]) and r[2] == 1.0 and r[3] == 5.0
    with pytest.raises(ValueError):
        V.distance("hamming")


def test_casts_wrap_and_quantisation_saturates(spark):
    v = spark.createDataFrame([([300.7, -1.0, 5.0, 9.0],)], "v array<double>")
    r = v.select(V.cast_elements(F.col("v"), "uint8"), V.cast_elements(F.col("v"), "int8"), V.quantize_int8(F.col("v"), 0, 256)).first()
    assert (list(r[0]), list(r[1]), list(r[2])) == ([44, 255, 5, 9], [44, -1, 5, 9], [127, -1, 5, 9])


def test_filters(spark):
    assert filters.row_range(line(spark), 3, 2).count() == 2
    assert [r.id for r in filters.sample_or_first(line(spark), 0.0).collect()] == [0]
    assert filters.sample(line(spark), 1.0).count() == 10
    with pytest.raises(ValueError):
        filters.row_range(line(spark), -1, 2)


def test_kmeans_and_shards(spark):
    numbers, points, residual = clusters.kmeans(line(spark, 20), 2, reps=20)
    assert residual <= 170.0 and abs(sorted(float(p[0]) for p in points)[0] - 4.75) <= 0.3
    assert clusters.to_shards(line(spark, 20), (numbers, points), 2).count() == 40
    a, b, _ = clusters.lloyd_iteration(line(spark), (np.array([0, 1]), np.array([[4.0], [99.0]])), strict=True)
    assert b[1][0] == 0.0
    _, c, _ = clusters.lloyd_iteration(line(spark), (np.array([0, 1]), np.array([[4.0], [99.0]])))
    assert c[1][0] == 99.0
    own, _ = clusters.shards_for_budget(line(spark, 200), 2e-6, 4)
    assert len(own) > 3
    assert len(clusters.seed_plusplus(np.arange(20.0)[:, None], 3)[0]) == 3


def test_pq(spark):
    assert pq.chunk_offsets(10, 4) == [0, 3, 6, 8, 10]
    assert pq.chunks_for_budget(3.3, 100_000_000, 128) == 32
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    m = pq.train(df, 4, pivots=32)
    codes = m.encode(x)
    assert ((m.decode(codes) - x) ** 2).sum() < 0.2 * (x**2).sum()
    q = x[0]
    exact = ((m.decode(codes) - q) ** 2).sum(1)
    assert np.allclose(m.table(q)[np.arange(4), codes].sum(1), exact)
    k = pq.two_phase_knn(df, pq.encode(df, m), df.filter("id = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), m, 5, 400)
    assert [r.id for r in k.orderBy("rank").collect()] == np.lexsort((np.arange(400), ((x - x[0]) ** 2).sum(1)))[:5].tolist()


def test_prune_order():
    pos = np.array([1.0, 2.0, -1.0])
    d = pos**2
    order = np.argsort(d, kind="stable")
    among = (pos[order][:, None] - pos[order][None]) ** 2
    assert graphs.robust_prune(d[order], among, 3, 1.0) == [0, 1]  # 2.0 hides behind 1.0
    assert graphs.robust_prune(d[order], among, 1, 1.2) == [0]


def test_search_stays_in_its_part_of_the_graph():
    s = graphs.Shard(np.arange(6), np.arange(6.0)[:, None], [np.array(x) for x in ([1], [0, 2], [1], [4], [3, 5], [4])], entries=[0])
    at, d = graphs.search_shard(s, np.array([5.0]), 6, 6)
    assert sorted(at.tolist()) == [0, 1, 2]
    gone = np.array([False, True, False, False, False, False])
    at, _ = graphs.search_shard(s, np.array([1.0]), 6, 6, deleted=gone)
    assert sorted(at.tolist()) == [0, 2]


@pytest.mark.parametrize("mode", ["beam", "page", "pipe", "batch"])
def test_full_pool_is_exact(mode):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    s = graphs.build_shard(np.arange(120), x, 8, 24)
    s.pages = np.arange(120) // 5
    for q in rng.normal(size=(5, 6)):
        at, _ = graphs.search_shard(s, q, 10, 120, 4, mode)
        assert at.tolist() == np.lexsort((np.arange(120), ((x - q) ** 2).sum(1)))[:10].tolist()
    assert max(map(len, s.nbrs)) <= 8 and all(i not in n for i, n in enumerate(s.nbrs))


def test_deletes_of_all_and_none(spark):
    tags = layout.identity_tags(line(spark))
    none = line(spark).select("id").limit(0)
    left, gone, failed = mutations.lazy_delete(tags, none, tags.select("tag").union(spark.range(99, 100)))
    assert left.count() == 0 and gone.count() == 10 and [r.tag for r in failed.collect()] == [99]
    left, gone, _ = mutations.lazy_delete(tags, none, none.select(F.col("id").alias("tag")))
    assert left.count() == 10 and gone.count() == 0
    assert mutations.compact_ids(none).count() == 0


def test_recall_counts_ties(spark):
    truth = spark.createDataFrame([(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 9, 2.0)], "qid long, rank long, id long, dist double")
    result = spark.createDataFrame([(0, 1, 8, 1.0)], "qid long, rank long, id long, dist double")
    assert stats.recall(result, truth, 1).first()["recall"] == 100.0


def test_layout_needs_neighbours(spark):
    graph = spark.createDataFrame([(i, []) for i in range(10)], "id long, nbrs array<long>")
    with pytest.raises(Exception, match="no neighbours"):
        layout.create_layout(line(spark), graph, 5, 4).collect()
    assert layout.rows_per_page(128, 96, 1) == 7 and layout.rows_per_page(2000, 96) == 1


def test_binary_files(spark, tmp_path):
    v = spark.createDataFrame([(i, [i + 0.5, -i * 1.0, 2.0]) for i in range(7)], "id long, vec array<float>")
    want = [(r.id, list(r.vec)) for r in v.collect()]
    for name, write, read in (
        ("a.bin", lambda f: binary.write_bin(v, f), lambda f: binary.read_bin(spark, f)),
        ("b.bin", lambda f: binary.write_bin(v, f, header_bytes=4096), lambda f: binary.read_bin(spark, f, header_bytes=4096)),
        ("c.fvecs", lambda f: binary.write_xvecs(v, f), lambda f: binary.read_xvecs(spark, f)),
    ):
        f = str(tmp_path / name)
        assert write(f) == 7
        assert [(r.id, list(r.vec)) for r in read(f).orderBy("id").collect()] == want
    assert tuple(binary.read_bin_header(spark, str(tmp_path / "a.bin")).select("rows", "columns").first()) == (7, 3)
    ids = spark.createDataFrame([(0, 5), (1, 4294967295)], "loc long, id long")
    binary.write_ids(ids, str(tmp_path / "ids.bin"))
    assert sorted(map(tuple, binary.read_ids(spark, str(tmp_path / "ids.bin")).collect())) == [(0, 5), (1, 4294967295)]
    small = spark.createDataFrame([(0, [255, 0]), (1, [1, 2])], "id long, vec array<int>")
    for kind, write, read in (("uint8", binary.write_bin, binary.read_bin), ("uint32", binary.write_xvecs, binary.read_xvecs)):
        f = str(tmp_path / kind)
        write(small, f, kind)
        assert [list(r.vec) for r in read(spark, f, kind).orderBy("id").collect()] == [[255, 0], [1, 2]]


def test_several_files_are_one_table(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    binary.write_bin(line(spark, 3), str(d / "0.bin"))
    binary.write_bin(line(spark, 2), str(d / "1.bin"))
    assert [(r.id, r.vec[0]) for r in binary.read_bin(spark, str(d)).orderBy("id").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 0.0), (4, 1.0)]


def test_truth_graph_and_result_files(spark, tmp_path):
    t = spark.createDataFrame([(q, r, 10 * q + r, r / 2) for q in range(2) for r in (1, 2)], "qid long, rank long, id long, dist double")
    binary.write_truth(t, str(tmp_path / "t"), 2)
    assert sorted(map(tuple, binary.read_truth(spark, str(tmp_path / "t")).collect())) == [(q, r, 10 * q + r, r / 2, 10 * q + r) for q in range(2) for r in (1, 2)]
    f = binary.write_result(t, str(tmp_path / "res"), 40, 2)
    assert f.endswith("res_40_idx_uint32.bin") and [list(r.vec) for r in binary.read_bin(spark, f, "uint32").orderBy("id").collect()] == [[1, 2], [11, 12]]
    g = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "id long, nbrs array<long>")
    binary.write_graph(g, str(tmp_path / "g"))
    assert [(r.id, list(r.nbrs)) for r in binary.read_graph(spark, str(tmp_path / "g")).orderBy("id").collect()] == [(0, [1, 2]), (1, []), (2, [0])]


def test_text_vectors(spark):
    lines = spark.createDataFrame([(0, " 1 2\t3 "), (1, "4 5 6")], "id long, value string")
    assert [list(r.vec) for r in text.parse_tsv(lines, 3).orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(Exception, match="without 2 numbers"):
        text.parse_tsv(lines, 2).collect()
    records = spark.createDataFrame([("k\tm\t1,2",), ("k\t3,4",), ("5,6",)], "value string")
    assert [(r.key, r.meta, list(r.vec)) for r in text.parse_records(records, 2).collect()] == [("k", "m", [1, 2]), ("k", None, [3, 4]), (None, None, [5, 6])]


def test_stream_of_changes(spark, tmp_path):
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    schema = "seq long, op string, tag long, vec array<float>"
    spark.createDataFrame([(1, "insert", 1, [1.0]), (2, "insert", 2, [2.0]), (3, "insert", 1, [9.0])], schema).coalesce(1).write.parquet(source)
    stream = lambda: changes.follow(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "cp"))
    stream().awaitTermination()
    assert sorted((r.tag, list(r.vec)) for r in changes.current(spark, path).collect()) == [(1, [9.0]), (2, [2.0])]
    spark.createDataFrame([(4, "delete", 2, None)], schema).coalesce(1).write.mode("append").parquet(source)
    stream().awaitTermination()
    assert [r.tag for r in changes.current(spark, path).collect()] == [1] and changes.versions(spark, path) == [0, 1]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_round_trip(spark, tmp_path, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    path = str(tmp_path / "index")
    build(df, path, Parameters(degree=12, pool=32, metric=metric, shard_rows=200, chunks=4))
    index = Index.open(spark, path)
    q = df.filter("id < 8").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    truth = knn.exact_knn(df, q, 10, metric)
    assert stats.recall(index.search(q, 10, 64, "beam"), truth, 10).first()["recall"] > 85
    assert stats.recall(index.search(q, 10, 100, "page", use_codes=True), truth, 10).first()["recall"] > 60
    with pytest.raises(ValueError):
        index.search(q, 10, 5)
    with pytest.raises(ValueError):
        Parameters(metric="hamming")

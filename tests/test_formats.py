"""Files that several tasks read, and formats there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import layout, pq
from nearfield.sources import binary


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vec").cache()


def same(a, b):
    a, b = ({r.id: list(r.vec) for r in x.collect()} for x in (a, b))
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_a_file_is_read_by_several_tasks(spark, base, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE_ROWS", 60)
    binary.write_bin(base, f"{tmp_path}/one.bin")
    binary.write_xvecs(base, f"{tmp_path}/one.fvecs")
    for df in (binary.read_bin(spark, f"{tmp_path}/one.bin"), binary.read_xvecs(spark, f"{tmp_path}/one.fvecs")):
        assert same(df, base)
        assert df.select(F.spark_partition_id()).distinct().count() > 1
    assert binary.read_bin_header(spark, f"{tmp_path}/one.bin").select("rows", "columns").first() == (500, 64)
    plan = binary.read_bin_header(spark, f"{tmp_path}/one.bin")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_directory_is_written_by_several_tasks(spark, base, tmp_path):
    written = binary.write_bin_parts(base, f"{tmp_path}/parts", rows=100).collect()
    assert len(written) == 5 and sum(r.rows for r in written) == 500
    assert same(binary.read_bin(spark, f"{tmp_path}/parts"), base)
    with open(f"{tmp_path}/parts/part-000000.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="don't hold"):
        binary.read_bin(spark, f"{tmp_path}/parts").count()


def test_disk_index_there_and_back(spark, base, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE_ROWS", 320)
    nodes = base.withColumn("nbrs", F.expr("transform(sequence(1, 3 + cast(id % 5 AS int)), x -> (id + x) % 500)"))
    assert binary.write_disk_index(nodes, f"{tmp_path}/disk", 6, 17) == 500
    got = binary.read_disk_index(spark, f"{tmp_path}/disk")
    assert same(got, base)
    per = layout.rows_per_page(64, 6)
    for r in got.collect():
        assert list(r.nbrs) == [(r.id + x) % 500 for x in range(1, 4 + r.id % 5)][:6] and (r.page, r.slot) == divmod(r.id, per)
    with pytest.raises(ValueError):
        binary.write_disk_index(nodes.withColumn("nbrs", F.expr("slice(nbrs, 1, 0)")), f"{tmp_path}/none", 6, 17)


def test_pivots_and_codes_there_and_back(spark, base, tmp_path):
    model = pq.train(base, 8, rows=400, reps=2)
    binary.write_pivots(model, f"{tmp_path}/pivots")
    back = binary.read_pivots(f"{tmp_path}/pivots")
    assert back.offsets == model.offsets and np.allclose(back.center, model.center, atol=1e-6)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(back.pivots, model.pivots, strict=True))
    codes = pq.encode(base, model)
    binary.write_bin(codes.select("id", F.col("codes").alias("vec")), f"{tmp_path}/codes", "uint8")
    assert same(binary.read_bin(spark, f"{tmp_path}/codes", "uint8"), codes.withColumnRenamed("codes", "vec"))


def test_id_maps_and_random_vectors(spark, tmp_path):
    ids = spark.createDataFrame([(0, 7), (1, 3)], "loc long, id long")
    binary.write_ids(ids, f"{tmp_path}/ids")
    assert binary.max_id(spark, f"{tmp_path}/ids") == 7
    local = spark.createDataFrame([(0, 1, 0.5)], "shard long, local_id long, dist double")
    assert binary.to_global(local, ids.selectExpr("0 AS shard", "loc AS local_id", "id")).first()["id"] == 3
    rows = [x for r in binary.random_vectors(spark, 200, 16).collect() for x in r.vec]
    assert min(rows) >= -128 and max(rows) <= 127 and len(set(rows)) > 200

"""SimHash links and components against all pairs, and odd rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import simhash


def slow_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in out.values() for i in g}


def test_fingerprints():
    for t in (None, "", "one", "a b", "A b C", "a b c d", "É É é x\ty z w", "the cat sat on the mat and the cat sat"):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_golay_code_is_perfect():
    index = simhash.golay_index()
    assert (index >= 0).all() and (np.bincount(index) == 2048).all()


def test_keys_meet_for_three_errors():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    for errors in range(4):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, errors, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        (ka, ra), (kb, rb) = simhash.keys(a), simhash.keys(b)
        own = set(zip(ka.tolist(), ra.tolist(), strict=True))
        assert len({r for k, r in zip(kb.tolist(), rb.tolist(), strict=True) if (k, r) in own}) == len(a)


def test_forest_spans_the_links():
    rng = np.random.default_rng(1)
    fps = np.array([0], np.uint64)
    for _ in range(300):
        fps = np.append(fps, fps[rng.integers(len(fps))] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)))
    fps = np.unique(fps)
    a, b = simhash.forest(fps)
    assert len(b) == len(fps) - 1 == len(set(b.tolist())) and (np.bitwise_count(fps[a] ^ fps[b]) <= 3).all()


def texts():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    base = [[words[k] for k in rng.integers(0, 400, 200)] for _ in range(25)]
    out = []
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(int(rng.integers(0, 5))):
                c[int(rng.integers(len(c)))] = words[int(rng.integers(400))]
            out.append(" ".join(c))
    return out + [out[0].upper(), out[0], None, "", " \n", "one", "ONE"]


@pytest.mark.parametrize("group_rows", [4, 4096])
def test_components(spark, group_rows):
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = {r.doc_id: r for r in simhash.link_documents(df, group_rows).collect()}
    want = brute([i for i, _ in rows], [slow_fingerprint(t) for _, t in rows])
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows) - 20


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e"), (3, "A B c d e"), (3, "A B c d e"), (None, "a b c d e"), (None, "other text of its own"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text_hash", F.lit(1))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([(3, "A B c d e"), (None, "other text of its own"), (8, "")], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.link_documents(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000


def test_keys_are_never_broadcast(spark):
    # 54 keys a fingerprint, of which Spark knows nothing: by its own count the join would be small enough to broadcast
    rng = np.random.default_rng(11)
    rows = [(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)]
    found = simhash.links(spark.createDataFrame(rows + [(rows[0][0] ^ 1,)], "fp long").groupBy("fp").agg(F.count(F.lit(1))))
    assert len(found.collect()) == 1
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()

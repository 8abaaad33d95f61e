"""The pipeline's stages on a small table, each held against what it should do to its own input."""

import corpus_pipeline
from nearfield.llm import mixing, quality_rules, secrets_scan


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        inputs.append(docs)
        docs = out.cache()
    kept = {r.doc_id for r in inputs[1].collect()}
    want = {r.doc_id for r in quality_rules.measure_documents(inputs[0]).filter("kept").select("doc_id").collect()}
    assert kept == want
    unique = {r.doc_id for r in inputs[2].collect()}
    assert unique < kept
    masked = inputs[3].collect()
    assert {r.doc_id for r in masked} == unique and not any(secrets_scan.base_spans(r.text) for r in masked)
    clean = {r.doc_id: r.text for r in inputs[2].collect() if not secrets_scan.base_spans(r.text)}
    assert sum(r.text == clean[r.doc_id] for r in masked if r.doc_id in clean) >= 0.98 * len(clean)
    copies = {r.doc_id: r.copies for r in mixing.plan_copies(inputs[3]).collect()}
    mixed = [r.doc_id for r in inputs[4].collect()]
    assert {d: mixed.count(d) for d in set(mixed)} == {d: n for d, n in copies.items() if n}
    assert docs.count() == len(mixed)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, words + " other end of it", "en", None, 5), (4, " ".join(f"w{i}x" for i in range(30000)), "en", "t", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, part in enumerate((rows, [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/0").collect()} <= {1, 4, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/1").count() == 0

import pytest

P = pytest.importorskip("public_tokenizers")


def test_stages_run_and_their_decisions_hold(spark, edge_docs, tmp_path):
    import corpus_pipeline

    from reelloom.llm import quality

    rows = [(i, f"start {i} " + " ".join(f"w{(i // 2) * 7 + k}" for k in range(80)), "en", ["s1", "s2"][i % 2], 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(edge_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
        if k == 0:
            assert {r.doc_id for r in docs.collect()} <= kept | {None, 3, 1}
        if k == 1:
            assert docs.count() == before.count()
        if k == 2:
            assert docs.count() <= before.count() and docs.count() > 0
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns) and docs.count() > 0


def test_near_duplicate_stage_keeps_one_row_a_simhash_component(spark):
    import corpus_pipeline

    from reelloom.llm import simhash

    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[: 200 + i]) + " " + " ".join(f"x{i}_{k}" for k in range(3 * i)), "en", "s1", 9) for i in range(40)]
    docs = spark.createDataFrame(rows + [(100, rows[0][1], "en", "s2", 9), (101, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    expected = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == expected

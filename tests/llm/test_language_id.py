import numpy as np
import pytest
from pyspark.sql import functions as F

from reelloom.llm import language_id as li


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    gru = li.Gru(3, rng)
    gru.table, gru.inner = gru.table.astype("f8"), gru.inner.astype("f8")
    x = rng.integers(0, 256, (5, 4))
    weight = rng.normal(size=(5, 3, 4))
    keep = []
    gru.run(x, keep)
    d_table, d_inner = gru.back(x, keep, weight)
    for p, g in ((gru.inner, d_inner), (gru.table, d_table)):
        for i, j in [(0, 0), (4, 1), (8, 2)] if p is gru.inner else [(0, x[0, 0]), (5, x[2, 1]), (7, x[4, 3])]:
            old, e = p[i, j], 1e-2
            p[i, j] = old + e
            up = (gru.run(x).astype("f8") * weight).sum()
            p[i, j] = old - e
            down = (gru.run(x).astype("f8") * weight).sum()
            p[i, j] = old
            assert (up - down) / (2 * e) == pytest.approx(g[i, j], rel=0.05, abs=5e-3)


def test_held_out_accuracy_and_whole_texts(spark):
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no driver tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = li.op3_language_id(spark, folder).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").toPandas()
    assert (found.lang == found.lang_pred).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_edges(spark, edge_docs, no_docs):
    model = li.ByteLabeller(["en", "fr"])
    out = li.predict(edge_docs, model)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and "n_words" in out.columns
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[4].lang_pred == "und" and by_id[4].score == 0 and by_id[2].lang_pred == "und" and by_id[12].lang_pred == "und"
    assert by_id[10].lang_pred in ("en", "fr")
    assert li.predict(no_docs, model).count() == 0
    assert li.fit(no_docs) is None
    assert {r.lang_pred for r in li.predict(edge_docs, None).collect()} == {"und"}
    assert li.fit(edge_docs.filter(F.col("lang") == "en")).langs == ["en"]


def test_segments_do_not_change_short_texts():
    model = li.ByteLabeller(["a", "b", "c"])
    text = bytes(range(97, 122)) * 40
    one = model.pool([text])
    assert np.allclose(model.pool([text, b"short", text])[0], one[0], atol=1e-5)


def test_pooling_against_a_plain_loop_over_bytes():
    """Whole texts, state by state with no segments: what segments with their warm-up leave out is nothing that shows."""
    soft = lambda x: x / (1 + np.abs(x))

    def states(gru, data):
        n = gru.inner.shape[1]
        h, out = np.zeros(n), []
        for b in data:
            u = gru.inner.astype("f8") @ h
            g = gru.table[:, b].astype("f8")
            z, r = (1 + soft(g[:n] + u[:n])) / 2, (1 + soft(g[n : 2 * n] + u[n : 2 * n])) / 2
            h = (1 - z) * h + z * soft(g[2 * n :] + r * u[2 * n :])
            out.append(h)
        return np.array(out)

    rng = np.random.default_rng(4)
    texts = [("the quick brown fox " * 150).encode(), "le renard brun et la forêt, ".encode() * 90, b"x", bytes(rng.integers(97, 123, 1500).tolist())]
    data = np.full((64, li.WINDOW), 32, "u1")
    for i in range(64):
        t, at = texts[i % 2], int(rng.integers(0, 1000))
        data[i] = np.frombuffer(t[at : at + li.WINDOW], "u1")
    model = li.ByteLabeller(["en", "fr"])
    model.train(data.astype(np.intp), np.arange(64) % 2, steps=60)
    got = model.pool(texts)
    for k, text in enumerate(texts):
        spaced = b" " * li.CONTEXT + text + b" " * li.CONTEXT
        both = np.concatenate([states(model.forward, spaced), states(model.backward, spaced[::-1])[::-1]], axis=1)[li.CONTEXT : -li.CONTEXT]
        score = both @ model.out.T.astype("f8") + model.bias[:, 0]
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        want = p[li.LETTER[np.frombuffer(text, "u1")]].mean(0)
        assert np.allclose(got[k], want, atol=1e-2), k


def test_ties_repeats_and_clashing_columns(spark):
    model = li.ByteLabeller(["a", "b"])
    model.out[:] = 0
    rows = [(1, "same", 1.5, "x", True), (1, "same", 2.5, "y", False), (2, "other", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string, _lettered boolean")
    out = li.predict(docs, model)
    assert out.columns == ["doc_id", "_lettered", "lang_pred", "score"]
    assert [(r.lang_pred, r.score) for r in out.collect()] == [("a", 0.5)] * 3
    named = spark.createDataFrame([(i, f"some text {i}", lang) for i, lang in enumerate(["", "", "q", None] + [f"l{k:02d}" for k in range(70)])], "doc_id long, text string, lang string")
    assert {lang for lang, _ in li.sample(named)} == {"", "q"} | {f"l{k:02d}" for k in range(70)}


def test_languages_of_nothing_but_short_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ab ab", "x"), ("ba", "x"), ("qz", "y"), ("q", "y"), ("zq zq", "y"), (" ", "y")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.langs == ["x", "y"]
    got = {r.doc_id: r.lang_pred for r in li.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, t, lang in rows if t.strip()) >= 20 and {got[i] for i, t, _ in rows if not t.strip()} == {"und"}
    assert li.fit(docs.filter("trim(text) = ''")) is None
    longer = docs.unionByName(spark.createDataFrame([(100 + i, "the quick brown fox jumps over it", "z") for i in range(5)], docs.schema))
    assert li.fit(longer).langs == ["x", "y", "z"]

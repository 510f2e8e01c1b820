import numpy as np
import pytest
from pyspark.sql import functions as F

from reelloom.llm import topk


def brute(rows, k=10):
    good = [(i, [int(np.floor(1024.0 * np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (dims - len(v))) for i, v in good]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    monkeypatch.setattr(topk, "HEAD", 40)
    monkeypatch.setattr(topk, "SLICE", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (2400, [1.0, 2.0]), (2500, []), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert topk.search(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0])], schema)
    assert topk.search(one, one).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_repeated_rows_and_scores_beyond_64_bits(spark):
    schema = "vec_id long, embedding array<double>"
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.rank, r.vec_id, r.score) for r in topk.search(rows, rows.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 2 << 20), (2, 1, 2 << 20), (3, 2, 1 << 20)]
    far = spark.createDataFrame([(0, [1e7]), (1, [-1e7])], schema)
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(far, far)
    assert topk.search(far.select("vec_id", F.transform("embedding", lambda x: x / 1000).alias("embedding")), far.limit(1)).count() == 1

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelloom.llm import near_copies as nc

pytest.importorskip("xxhash")


def slow_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def roots(sets):
    sets = sorted(set(sets), key=sorted)
    up = {s: s for s in sets}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b) > 0:
                up[find(a)] = find(b)
    return {s: find(s) for s in sets}


def test_the_stage_keeps_one_of_texts_alike_at_four_fifths(spark, edge_docs):
    from corpus_pipeline import near_duplicate_stage

    rng = random.Random(3)
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 6, 9):
            near = list(words)
            for i in rng.sample(range(len(near)), changes):
                near[i] = f"v{rng.randrange(5000)}"
            texts.append(("\n" if k % 2 else " ").join(near).upper() if changes == 2 else " ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    rows = docs.collect()
    root = roots(slow_set(r.text) for r in rows)
    assert len(set(root.values())) < len(root) - 40
    best = {}
    for r in rows:
        best.setdefault(root[slow_set(r.text)], []).append((r.doc_id is None, r.doc_id or 0))
    kept = near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min(v) for v in best.values())


def test_buckets_are_paired_across_partitions(spark):
    rng = np.random.default_rng(4)
    mins = rng.integers(0, 3, (60, nc.HASHES)).astype("<u4")
    classes = spark.createDataFrame([(i, 1, bytearray(m.tobytes())) for i, m in enumerate(mins)], "fp long, size long, mins binary")
    want = set()
    for band in range(nc.BANDS):
        names = [x[:8].tobytes() for x in nc.places(mins, band)]
        want |= {(i, j) for j in range(60) for i in range(j) if names[i] == names[j]}
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {(r.a, r.b) for r in nc.candidates(classes).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize(("first", "following"), [(1, 4)])
def test_crowded_buckets_are_not_cut_short(spark, first, following):
    """One template with a wandering part: large buckets of several components, and far more classes in each than a window holds."""
    rng = random.Random(first + following)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(12):
        own = [f"k{k}_{i}" for i in range(45)]  # two of these differ by too much
        for j in range(4):
            words = base + own
            for i in rng.sample(range(len(words)), 2):
                words[i] = f"x{k}_{j}_{i}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = nc.cut(nc._marked(docs).groupBy("fp").agg(F.min(row).alias("least"), F.min("size").alias("size"), F.min("mins").alias("mins")))
    graph = nc.settled(docs, classes, first, following, whole=True)
    got = {}
    for r in classes.join(graph, F.col("fp") == F.col("node"), "left").collect():
        got.setdefault(r.component if r.component is not None else r.fp, set()).add(texts[r.least.doc_id])
    want = {}
    for s, top in roots(slow_set(t) for t in texts).items():
        want.setdefault(top, set()).add(s)
    assert sorted(map(len, got.values())) == sorted(map(len, want.values())) and 10 < len(want) < 48
    assert {frozenset(slow_set(t) for t in v) for v in got.values()} == {frozenset(v) for v in want.values()}


def test_nothing(spark, no_docs):
    assert nc.keep_one(no_docs).count() == 0


def test_short_and_blank_texts_are_one_shingle_or_none():
    assert len(nc.shingles("One two")) == 1 and np.array_equal(nc.shingles("One\ttwo "), nc.shingles("one two"))
    assert len(nc.shingles(" \n")) == 0 and len(nc.shingles("a b c d e f")) == 2

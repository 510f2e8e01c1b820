import hashlib
import math
import random

import pytest

from reelloom.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares again and again until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * w[s]) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


def factor(words, target, most=3):
    """c with sum(min(most, c * measure) * words) = target, by halving; words by measure."""
    lo, hi = 0.0, float(most)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most, mid * m) * n for m, n in words.items()) < target else (lo, mid)
    return hi


def brute_mix(rows, want, sizes, most=3, seed=42):
    """Copies by doc_id: the whole order of each source at once."""
    copies = {}
    for s in {r[2] for r in rows}:
        mine = [(d, len(t.split()), t) for d, t, x in rows if x == s]
        words = {}
        for _, n, _ in mine:
            words[len(f"{n:b}")] = words.get(len(f"{n:b}"), 0) + n
        if not sizes[s]:
            copies |= {d: 0 for d, _, _ in mine}
            continue
        c = factor(words, want[s])
        per = {d: min(most, c * len(f"{n:b}")) for d, n, _ in mine}
        per = {d: most if most - m < 1e-9 else m for d, m in per.items()}
        left = want[s] - sum(math.floor(per[d]) * n for d, n, _ in mine)
        ranked = []
        for d, n, t in mine:
            key = "|".join([str(seed), str(d), "\0" if s is None else s, t])
            u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = per[d] % 1
            copies[d] = math.floor(per[d])
            if p > 0:
                ranked.append((u / (1 - u) / (p / (1 - p)), d, n))
        sofar = 0
        for _, d, n in sorted(ranked):
            sofar += n
            copies[d] += sofar - n / 2 <= left
    return copies


def test_inclusion_follows_the_measure(spark):
    rng = random.Random(8)
    texts = [" ".join("w" for _ in range(rng.choice([3, 20, 90, 400]))) for _ in range(60)]
    rows = [(i, t, f"r{r:03d}") for r in range(300) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1,)).groupBy("doc_id").avg("copies").collect()
    words = {}
    for t in texts:
        n = len(t.split())
        words[len(f"{n:b}")] = words.get(len(f"{n:b}"), 0) + n
    c = factor(words, sum(words.values()))
    wanted = {i: min(3, c * len(f"{len(t.split()):b}")) for i, t in enumerate(texts)}
    assert len({round(w, 3) for w in wanted.values()}) == 4  # unequal within a source
    for r in got:
        assert r["avg(copies)"] == pytest.approx(wanted[r.doc_id], abs=0.15)


def test_one_row_repeated_often_is_cut_exactly(spark):
    rows = [(1, "a b c d", "s", "x")] * 301 + [(1, "a b c d", "s", "y")] * 99 + [(i, "a b", "t", "x") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    want = brute_targets({"s": 1600, "t": 20})
    assert sum(r.taken for r in got if r.source == "s") == pytest.approx(want["s"], abs=4)
    assert len(got) == len(rows)
    mixed = mixing.repeat_rows(docs)
    counted = {(r.source, r["size"]): r["count"] for r in mixed.groupBy("source", "size").count().collect()}
    assert counted["s", "x"] + counted["s", "y"] == sum(r.copies for r in got if r.source == "s")
    assert abs(counted["s", "x"] - 301) <= 11 and abs(counted["s", "y"] - 99) <= 11


def test_targets_and_sums(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        s = rng.choice(["hot"] * 6 + ["a", "é", "z", None, "tiny"] if i % 50 == 0 else ["hot"] * 4 + ["a", "é", "z", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 60))), s, 0.5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, u double")
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 61
    drawn = brute_mix([(r[0], r[1], r[2]) for r in rows], want, sizes)
    assert {r.doc_id: r.copies for r in got} == drawn
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_edges(spark, edge_docs, no_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0)
    repeated = mixing.repeat_rows(edge_docs)
    assert repeated.columns == edge_docs.columns
    assert repeated.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat_rows(no_docs).count() == 0

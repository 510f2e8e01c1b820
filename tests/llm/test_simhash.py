import random
import re

import pytest

from reelloom.llm import simhash

xxhash = pytest.importorskip("xxhash")


def slow_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, radius=3):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_links_join_exactly_what_is_near(spark):
    rng = random.Random(7)
    fps = []
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.append(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    signed = [simhash._signed(f) for f in set(fps)]
    from reelloom.llm.components import components

    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in pairs.collect())
    got = {r.node: r.component for r in components(pairs).collect()}
    want = roots([f & (2**64 - 1) for f in signed])
    groups = lambda m: {frozenset(x for x in m if m[x] == v) for v in m.values()}
    full = {simhash._signed(f): simhash._signed(r) for f, r in want.items()}
    assert groups({f: got.get(f, f) for f in signed}) == groups(full)


def test_documents(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fp = {(r.doc_id, r.text): slow_fingerprint(r.text) for r in rows}
    assert sorted(simhash._signed(slow_fingerprint(r.text)) for r in rows) == sorted(r.fp for r in got)
    root = roots(fp.values())
    best = {}
    for (d, _), f in fp.items():
        if d is not None:
            best[root[f]] = min(best.get(root[f], d), d)
    assert {(r.doc_id, r.fp, r.component_id) for r in got} == {(d, simhash._signed(f), best.get(root[f])) for (d, _), f in fp.items()}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(spark, edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = edge_docs.select("doc_id", "text").collect()
    root = roots(slow_fingerprint(r.text) for r in rows)
    assert kept.count() == len(set(root.values()))
    assert {root[slow_fingerprint(r.text)] for r in kept.collect()} == set(root.values())
    assert simhash.keep_one(no_docs).count() == 0


def test_the_least_id_stays_whatever_the_columns_are_called(spark):
    texts = ["one two three four five six", "quite another text with words of its own", None]
    rows = [(d, texts[k]) for k, ids in enumerate([[9, 4, 4, None, 7], [None, None], [3, 2]]) for d in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS key", "3 AS root", "4 AS least", "5 AS none", "6 AS component")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, texts[0]), (None, texts[1]), (2, None)], key=str)


def test_components_of_a_long_chain(spark):
    from reelloom.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_one_fingerprint_and_one_component_with_half_of_all_rows(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(n))
    base = text(300).split()
    rows = [(i, " ".join(base)) for i in range(400)]
    for i in range(400, 600):
        words = list(base)
        words[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, text(120)) for i in range(600, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = sorted({fp for fp, _ in got.values()})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, (fp, _) in got.items():
        least[root(fp)] = min(d, least.get(root(fp), d))
    assert {d: c for d, (_, c) in got.items()} == {d: least[root(fp)] for d, (fp, _) in got.items()}
    assert simhash.fit_blocks(10**6) == 8 < simhash.fit_blocks(10**10)

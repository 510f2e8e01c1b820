import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from reelloom.llm import merkle


def h(x):
    return sha256(x.encode()).hexdigest()


def plain_leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(level):
    """The root of a list of nodes, and for each the siblings (left, right) on its way up."""
    paths, at = [[] for _ in level], [i for i in range(len(level))]
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            lo = i // 3 * 3
            p.append((level[lo:i], level[i + 1 : lo + 3]))
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def brute(rows):
    """Every row's answer by plain recursion over lists."""
    trees = {}
    for r in rows:
        odd = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2
        copied = r.text if odd or r.text is None else r.text.replace("\n", "")
        trees.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), plain_leaf(r, copied), r.doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    climbed = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, over = climb([climbed[s][0] for s in names]) if names else (None, [])
    out = []
    for s, above in zip(names, over, strict=True):
        for x, path in zip(sorted(trees[s], key=lambda x: x[:3]), climbed[s][1], strict=True):
            steps, folded = [*path, *above], x[3]
            for left, right in steps:
                folded = h("".join([*left, folded, *right]))
            proof = h("".join("".join(left + right) for left, right in steps))
            out.append((x[4], x[2], climbed[s][0], root, proof, folded, folded == root))
    return out


def check(spark, docs, tmp_path, name="a", depth=merkle.DEPTH):
    docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path / name), depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    order = lambda rows: sorted(rows, key=str)
    found = order(tuple(r) for r in got.collect())
    assert found == order(brute(docs.collect()))
    return found


def test_edge_rows(spark, edge_docs, no_docs, tmp_path):
    check(spark, edge_docs, tmp_path)
    assert check(spark, no_docs, tmp_path, "b") == []
    one = check(spark, edge_docs.limit(1), tmp_path, "c")
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")


def test_many_superblocks(spark, tmp_path):
    """Small superblocks, so that trees take several rounds, with one hot source and many small ones."""
    rng = random.Random(4)
    rows = [(i, "a\nb" if rng.random() < 0.5 else f"text {i}", "en", "hot" if i % 3 == 0 else f"s{rng.randint(0, 150)}", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = check(spark, docs, tmp_path, depth=2)
    assert {r[6] for r in found} == {True, False}


def test_proof_is_portable(spark, edge_docs):
    """The proof string alone leads from a leaf to the root."""
    for r in merkle.manifest(merkle.leaves(edge_docs)).collect():
        now = r.leaf
        for step in r.proof.split("/") if r.proof else []:
            left, right = step.split("|")
            now = h(left + now + right)
        assert now == r.root == r.folded


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 729, 730])
def test_height(n):
    size, levels = n, 0
    while size > 1:
        size, levels = -(-size // 3), levels + 1
    assert merkle._height(n) == levels


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    try:
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    except duckdb.Error:
        pytest.skip("no driver tables here")
    want = duck.execute(merkle.OP12_SQL).fetchall()
    got = merkle.op12_merkle_manifest(spark, folder)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert got.filter(F.col("verified")).count() < got.count()

import random

from reelloom.llm import line_dedup as ld


def brute(rows):
    """rows: distinct (doc_id, text) in order; texts without later occurrences of three-line windows."""
    seen, gone = {}, {}
    for d, t in rows:
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")]
        for k in range(len(lines) - 2):
            win = tuple(x for _, x in lines[k : k + 3])
            if win in seen:
                gone.setdefault(d, set()).update(i for i, _ in lines[k : k + 3])
            else:
                seen[win] = d
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["p", "q", "r", "s", "", "  ", "long line %d" % rng.randint(0, 3)]) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lines string")
    out = ld.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_edge_rows(spark, edge_docs, no_docs):
    out = {(r.doc_id, r.n_chars): r.text for r in ld.dedup(edge_docs).collect()}
    assert ld.dedup(edge_docs).count() == edge_docs.count()
    assert out[7, 5] == "a\nb\nc\nd" and out[8, 5] == ""
    assert out[4, 5] is None and out[2, 5] == ""
    assert ld.dedup(no_docs).count() == 0


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ld.dedup(docs).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def test_one_window_in_half_of_all_documents(spark):
    rows = [(i, f"head {i}\nsame a\nsame b\nsame c\ntail {i}" if i % 2 else f"x {i}\ny {i}\nz {i}\nw {i}") for i in range(1000)]
    got = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == (t if i % 2 == 0 or i == 1 else f"head {i}\ntail {i}")

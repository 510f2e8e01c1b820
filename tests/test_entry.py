"""The driver's contract, and each query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
CORE = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("~" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(FOLDER))
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), names)


def test_titles_of_odd_headings_equal_the_sql(spark, duck, tmp_path):
    inner = ["&quot;a&quot;", "a&amp", "&amp;lt;b&amp;gt;", "&nbsp;c&#39;s&nbsp;", "A (2021 film)", "", " \t<b>x</b>\x0b\f y ", "\u00a0z\u2003", "\u0085a\u2028", "–· q |;", "<sup>[1]</sup>n [2]", "< b", "a > b", None]
    pages = [None if x is None else f"<h1 class='k'>{x}</h1><h1>second</h1>" for x in inner]
    pages += ["", "no heading", "<h1>open", "<H1>capitals</H1>", "<!-- <h1>noted</h1> --><h1>shown</h1>", "<h1>a\n<h1>b</h1>", "<h1/>c</h1>", "<h1 x='>'>d</h1>"]
    schema = "page_id long, url string, html string"
    spark.createDataFrame([(k, f"u{k}", html) for k, html in enumerate(pages)], schema).write.parquet(f"{tmp_path}/pages.parquet")
    want = duck.execute(f"WITH pages AS (FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')) {entry.oracle_sql()['x19_titles']}").fetchall()
    got = entry.queries()["x19_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == len(pages)


def test_flagship(spark):
    if not FOLDER.exists():
        pytest.skip("no driver tables here")
    assert entry.entry(spark).count() == 20


def test_session_fold_equals_the_batch(spark):
    from reelloom.plans import texts

    if not FOLDER.exists():
        pytest.skip("no driver tables here")
    stream = {r.session_id: (r.status, r.used, r.bonus_unlocked) for r in entry.queries()["t3_session_fold"](spark, str(FOLDER)).collect()}
    batch = {r.session_id: (r.status, r.used, r.bonus_unlocked) for r in texts.batch_outcomes(spark, str(FOLDER)).collect()}
    assert {s: v for s, v in batch.items() if s in stream} == stream


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(entry.__file__).parent, env=os.environ, timeout=120)
    assert done.returncode == 0, done.stderr

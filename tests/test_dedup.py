"""Each order-sensitive rewrite against a plain sequential statement of it, and under other partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from reelloom.operators import dedup


def candidates(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice("abcd"), rng.choice([1999, 2000, None]), rng.choice([None, "", "u1", "u2", "u3#x", "u3"]), rng.choice(["", None, "d1", "d2"]), rng.choice([[], ["p"], ["q", "r"]]), rng.randint(0, 4)) for i in range(n)]


SCHEMA = "seq long, key string, year int, url string, director string, actors array<string>, filled int"


def sequential(rows, richest):
    by_key, by_url = {}, {}
    for r in rows:
        key, url = (r[1], r[2]), (r[3] or "").split("#")[0]
        if url and url in by_url and by_url[url][1] == r[2]:
            key = by_url[url]
        if key not in by_key:
            by_key[key] = list(r)
        elif richest:
            if r[6] > by_key[key][6]:
                by_key[key] = list(r)
        else:
            for k in (4, 5):
                by_key[key][k] = by_key[key][k] or r[k]
        if url:
            by_url.setdefault(url, key)
    return by_key


@pytest.mark.parametrize("seed", range(3))
def test_merge_and_richest(spark, seed):
    rows = candidates(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    merged = {(r.ckey, r.year): (r.seq, r.director or None, r.actors or []) for r in dedup.merge_candidates(df, "key", "year", "url", ["director", "actors"]).collect()}
    assert merged == {k: (v[0], v[4] or None, v[5]) for k, v in sequential(rows, False).items()}
    best = {(r.ckey, r.year): r.seq for r in dedup.richest(df, "key", "year", "url", "filled").collect()}
    assert best == {k: v[0] for k, v in sequential(rows, True).items()}


def test_fixture_rows(spark):
    rows = [(1, "a", 2000, "u", "", [], 0), (2, "b", 2001, "u", "", [], 0), (3, "c", 2001, "u", "", [], 0)]
    out = dedup.merge_candidates(spark.createDataFrame(rows, SCHEMA), "key", "year", "url", ["director"])
    assert out.count() == 3  # only the first key of an address counts, and its year differs


def test_numbers_are_sequential(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1999, 2000, 2001]), rng.choice("xyzé")) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, year int, name string").repartition(7)
    got = {r.i: r.id for r in dedup.number(df, ["year", "name", "i"]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(want, 1)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (7, "b", "y")], "id long, k string, v string")
    new = spark.createDataFrame([(0, "b", "Y"), (0, "c", "z"), (0, "d", None)], "id long, k string, v string")
    got = {r.k: (r.id, r.v, r.action) for r in dedup.upsert(old, new, ["k"], "id").collect()}
    assert got == {"a": (1, "x", "kept"), "b": (7, "Y", "updated"), "c": (8, "z", "inserted"), "d": (9, None, "inserted")}


def test_aliases_and_patterns(spark):
    aliases = spark.createDataFrame([("eega", "Eega", "normalised"), ("Makkhi", "Eega", "redirect"), ("l1", "l2", "redirect"), ("l2", "l3", "redirect"), ("Yogi (film)", "Yogi (2007 film)", "redirect")], "from string, to string, kind string")
    there = spark.createDataFrame([("Eega",), ("l3",), ("Yogi (2007 film)",), ("Yogi",)], "title string")
    titles = spark.createDataFrame([("eega",), ("Makkhi",), ("nothing",), ("l1",)], "title string")
    assert {r.title: r.target for r in dedup.resolve_aliases(titles, aliases, there).collect()} == {"eega": "Eega", "Makkhi": "Eega", "nothing": None, "l1": "l3"}
    asked = spark.createDataFrame([(1, "Yogi", 2007), (2, "Gone", 2001)], "seq long, name string, year int")
    out = {r.seq: r.target for r in dedup.resolve_by_patterns(asked, aliases, there, ["{name} ({year} film)", "{name} (film)", "{name}"]).collect()}
    assert out == {1: "Yogi (2007 film)", 2: None}


def test_gaps_are_filled_and_nothing_overwritten(spark):
    works = spark.createDataFrame([("k", 2000, [], ["D"]), ("q", 2001, [], [])], "key string, year int, actors array<string>, directors array<string>")
    credits = spark.createDataFrame([("k", 2000, 2, ["no"], ["no"]), ("k", 2000, 1, [f"a{i}" for i in range(12)], ["E"])], "key string, year int, rank int, actors array<string>, directors array<string>")
    got = {r.key: r for r in dedup.fill_gaps(works, credits, ["actors", "directors"], "credits").collect()}
    assert len(got["k"].actors) == 10 and got["k"].directors == ["D"] and got["k"].filled == ["actors"] and got["k"].sources == ["primary", "credits"]
    assert got["q"].actors == [] and got["q"].sources == ["primary"]


def test_release_dates_queues_and_hits(spark):
    works = spark.createDataFrame([(1, "", None), (2, "2001-01-01", 2001), (3, None, 1999)], "i int, release_date string, year int")
    claims = F.array(F.lit("no date"), F.lit("+2004-05-06T00:00:00Z"))
    got = {r.i: (r.release_date, r.year, r.filled) for r in dedup.fill_release_date(works, claims).collect()}
    assert got == {1: ("2004-05-06", 2004, True), 2: ("2001-01-01", 2001, False), 3: ("2004-05-06", 1999, True)}
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq int, url string")
    assert [r.seq for r in dedup.enqueue(rows.filter("url = 'b'"), rows, "url").collect()] == [1]
    hits = spark.createDataFrame([("q", 1, "List of 1999"), ("q", 2, "Telugu films of 2000"), ("q", 3, "telugu 2000")], "query string, rank int, title string")
    assert dedup.first_hit(hits, F.lit(2000), "Telugu").first().title == "Telugu films of 2000"


def test_upsert_joins_once(spark):
    """New ids, the largest id and the rows all come from one kept join."""
    old = spark.range(5).selectExpr("id", "cast(id as string) AS k")
    done = dedup.upsert(old, spark.range(3, 9).selectExpr("id", "cast(id as string) AS k"), ["k"], "id")
    assert "FullOuter" not in done._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.k, r.action) for r in done.collect())[3:] == [(3, "3", "updated"), (4, "4", "updated"), (5, "5", "inserted"), (6, "6", "inserted"), (7, "7", "inserted"), (8, "8", "inserted")]

"""The batch search against a plain ranking of all titles for each query."""

import random

from pyspark.sql import functions as F

from reelloom.functions import text as tx
from reelloom.operators import search


def plain(titles, text, year, limit):
    """titles: (id, title, year, key)."""
    found = []
    for i, title, y, key in titles:
        squeezed, compact = key.replace(" ", ""), text.replace(" ", "")
        if not (text in key or (compact != text and compact in squeezed)) or (year is not None and y != year):
            continue
        rank = 0 if key == text or squeezed == compact else 1 if key.startswith(text) else 2
        found.append((rank, len(key), y is None, -(y or 0), title, i))
    return [(place, x[-1], x[0]) for place, x in enumerate(sorted(found)[:limit], 1)]


def test_batch_search_against_a_plain_ranking(spark):
    rng = random.Random(6)
    parts = ["Red", "Redder", "Sun", "The", "A", "Sunred", "Amélie", "x"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(1, 3))), rng.choice([None, 1999, 2001, 2002])) for i in range(400)]
    titles = spark.createDataFrame(rows, "id long, title string, year int").withColumn("key", tx.search_key(F.col("title")))
    asked = ["red", "re", "r", "sun red", "s unr", "the 2001", "2001", "red 1999", "zz", "", "AMÉLIE a", "d", "redd 2002", "red 2077"] + [f"{a} {b}" for a in parts for b in parts]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked * 2)], "query_id long, query string")
    known = [tuple(r) for r in titles.select("id", "title", "year", "key").collect()]
    parsed = queries.select("query_id", tx.query_parts(F.col("query")).alias("q")).select("query_id", "q.text", "q.year").collect()
    for limit in (1, 5, 12):
        want = sorted((r.query_id, *x) for r in parsed if r.text for x in plain(known, r.text, r.year, limit))
        got = sorted(tuple(r) for r in search.batch_search(titles, queries, limit).select("query_id", "place", "id", "rank").collect())
        assert got == want


def test_repeated_titles_and_empty_tables(spark):
    titles = spark.createDataFrame([(i, "Same", 2000) for i in range(50)], "id long, title string, year int").withColumn("key", tx.search_key(F.col("title")))
    queries = spark.createDataFrame([(1, "same"), (2, "same"), (3, "SAME 2000"), (4, None)], "query_id long, query string")
    got = search.batch_search(titles, queries, 3).collect()
    assert sorted((r.query_id, r.place, r.id) for r in got) == [(q, p, p - 1) for q in (1, 2, 3) for p in (1, 2, 3)]
    assert search.batch_search(titles.limit(0), queries).count() == 0 and search.batch_search(titles, queries.limit(0)).count() == 0

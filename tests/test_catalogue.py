"""The catalogue's keys and picks: made once where they stand, with the rows of the plain way."""

import datetime

from pyspark.sql import functions as F

from reelloom.operators import comparison as cmp
from reelloom.operators import selection
from reelloom.plans.adapters import star


def test_keys_of_names_are_those_of_works(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    put("part", [(1, "Ring-A", "PROMO", "B'1"), (2, None, "promo", "..."), (3, "ring a", "PROMO", None)], "p_partkey long, p_name string, p_type string, p_brand string")
    put("supplier", [(1, "Ünder", 1), (2, None, 2)], "s_suppkey long, s_name string, s_nationkey int")
    put("nation", [(1, "N  1"), (2, None)], "n_nationkey int, n_name string")
    put("customer", [(1, "C#1"), (2, None)], "c_custkey long, c_name string")
    day = datetime.datetime(2000, 1, 1)
    put("orders", [(1, 1, day), (2, 2, day), (3, 9, day), (4, 1, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    put("lineitem", [(1, 1, 1, 1), (1, 2, 2, 2), (1, 3, 1, 3), (2, 2, 2, 1), (4, 3, 1, 2), (4, 3, 1, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    plain, keyed = cmp.with_keys(star(spark, str(tmp_path))), star(spark, str(tmp_path), keyed=True)
    assert keyed.columns == plain.columns
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, keyed.collect())) == want and len(want) == 4
    assert want[0][plain.columns.index("k_genres")] == ["promo", "promo"]


def test_asked_places_are_those_of_the_whole_order(spark):
    pool = spark.range(3000).withColumnRenamed("id", "movie_id")
    whole = {r.place: r.movie_id for r in selection.shuffled(pool, "s").collect()}
    places = [0, 1, 2, 777, 2999, 2999, 3000, None]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    found = {r.place: r.movie_id for r in selection.at_places(pool, asked, "s").collect()}
    assert {p: found[p] for p in (0, 1, 2, 777, 2999)} == {p: whole[p] for p in (0, 1, 2, 777, 2999)}
    assert len(found) < 100 and all(whole[p] == i for p, i in found.items())
    assert selection.at_places(pool.filter("movie_id < 0"), asked, "s").count() == 0
    assert selection.at_places(pool, asked.filter(F.col("place") == 3000), "s").count() == 0

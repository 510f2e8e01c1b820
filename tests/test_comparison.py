import pytest
from pyspark.sql import functions as F

from reelloom.operators import comparison as cmp

WORK = "movie_id long, title string, year int, genres array<string>, actors array<string>, directors array<string>, houses array<string>, music array<string>, writers array<string>"


@pytest.fixture(scope="module")
def compared(spark):
    def run(guess, mystery):
        base = {"title": "T", "year": None, "genres": [], "actors": [], "directors": [], "houses": [], "music": [], "writers": []}
        one = lambda d, i: spark.createDataFrame([{"movie_id": i} | base | d], WORK)
        g, m = cmp.with_keys(one(guess, guess.get("movie_id", 1))), cmp.with_keys(one(mystery, mystery.get("movie_id", 2)))
        return cmp.compare(cmp.side(g, "g").join(cmp.side(m, "m"), how="cross"))

    return run


@pytest.mark.parametrize(("g", "m", "want"), [(2000, 2000, ("correct", "same", 2000)), (2001, 2000, ("absent", "earlier", None)), (1999, 2000, ("absent", "later", None)), (None, 2000, ("unknown", "unknown", None))])
def test_years(compared, g, m, want):
    assert tuple(compared({"year": g}, {"year": m}).first().year_result) == want


@pytest.mark.parametrize(
    ("g", "m", "common", "status"),
    [
        (["Drama", "Action"], ["action", "War"], ["Action"], "partial"),
        (["A"], ["B"], [], "absent"),
        (["a", "B"], ["b", "A"], ["a", "B"], "correct"),
        ([], ["B"], [], "unknown"),
        (["..."], ["B"], [], "absent"),
        (["S. S. R", "s s r"], ["S S R"], ["S. S. R"], "correct"),
    ],
)
def test_sets(compared, g, m, common, status):
    r = compared({"genres": g}, {"genres": m}).first()
    assert (r.common_genre, r.status_genre) == (common, status)


def test_cast_positions_and_what_is_disclosed(compared):
    c = compared({"actors": ["X", "Shared", "shared", "Other"], "directors": ["D"], "year": 2000}, {"actors": ["Hidden", "", "SHARED"], "directors": ["D", "E"], "title": "Secret", "year": 2001})
    assert [tuple(x) for x in c.first().cast_matches] == [("Shared", 2, 3)]
    shown = cmp.disclosed(c, F.lit(False)).toJSON().first()
    for secret in ("Hidden", "Secret", "2001", "mystery_position"):
        assert secret not in shown
    assert cmp.disclosed(c, F.lit(True)).first().mystery_title == "Secret"
    assert c.select(cmp.revealed().alias("x")).first().x == ["director"]


def test_same_title_is_not_the_same_work(compared):
    assert not compared({"movie_id": 5}, {"movie_id": 6}).first().is_correct
    assert compared({"movie_id": 5}, {"movie_id": 5}).first().is_correct

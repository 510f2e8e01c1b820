import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelloom.sources import files


def test_csv_in(spark, tmp_path):
    head = "movie_id,movie_name,year,genre,cast"
    (tmp_path / "a.csv").write_text(f'{head}\n1,"A, ""B""",2000,Action| action ||Drama,X|Y\n2,,abc,,\n3,C,2006.0,,\n')
    works = files.as_works(files.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert [(w.title, w.year, w.genres, w.actors) for w in works] == [('A, "B"', 2000, ["Action", "Drama"], ["X", "Y"]), (None, None, [], []), ("C", None, [], [])]
    (tmp_path / "b.csv").write_text("movie_id,year\n1,2000\n")
    with pytest.raises(ValueError, match="movie_name"):
        files.read_csv(spark, str(tmp_path / "b.csv"))


def test_json_in(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"movie_name": "A", "year": 2001, "cast": [" X ", "x", "Y"]}, {"movie_name": "B", "year": "n"}]))
    works = files.as_works(files.read_json(spark, str(tmp_path / "a.json"))).collect()
    assert [(w.title, w.year, w.actors) for w in works] == [("A", 2001, ["X", "Y"]), ("B", None, [])]


def test_csv_out_and_page_store(spark, tmp_path):
    schema = "movie_id long, title string, year int, language string, url string, genres array<string>, actors array<string>, directors array<string>, houses array<string>, music array<string>, writers array<string>"
    works = spark.createDataFrame([(1, 'q"t', 2000, None, "u", ["a", "b"], [], [], [], [], [])], schema)
    files.write_csv(works, str(tmp_path / "out"), "en")
    back = files.read_csv(spark, str(tmp_path / "out")).first()
    assert (back.movie_name, back.year, back.language, back.genre, back.cast or "") == ('q"t', "2000", "en", "a|b", "")
    pages = spark.createDataFrame([(1, "http://a", "<p>"), (2, "http://b", "<p>")], "page_id long, url string, html string")
    files.write_page_store(pages, str(tmp_path / "store"))
    assert [r.page_id for r in files.read_pages(spark, str(tmp_path / "store"), pages.filter("page_id = 2")).collect()] == [2]


def test_counters_of_a_run_are_taken_as_stages_are_written(spark, tmp_path):
    queue = spark.createDataFrame([("a", "failed", 2), ("b", "success", 1), ("c", "pending", 0)], "url string, status string, attempts long")
    run = files.Run(str(tmp_path / "run"))
    kept = run.write(queue, "queue", **files.states())
    assert run["queue"] == {"rows": 3, "pending": 1, "success": 1, "failed": 1, "attempts": 3} and kept.count() == 3
    works = spark.createDataFrame([(1, 2001, ["x"]), (2, 2003, []), (3, 2001, ["y"])], "movie_id long, year int, genres array<string>")
    run.write(works, "dataset", **files.gaps({"genre": "genres"}))
    report = json.loads(files.run_report(spark, {"movies_scraped": 1}, run["dataset"], run["queue"], {"works": 3}).first().report)
    assert report["dataset"] == {"records": 3, "years": [2001, 2003]} and report["missing_counts"] == {"genre": 1} and report["field_coverage_percent"] == {"genre": 66.6}
    assert report["database"]["failed"] == 1 and report["sources"] == {"works": 3}


def test_counters_of_empty_stages(spark, tmp_path):
    run = files.Run(str(tmp_path / "run"))
    run.write(spark.createDataFrame([], "url string, status string, attempts long"), "queue", **files.states())
    run.write(spark.range(3).filter("id > 5").select(F.col("id").cast("int").alias("year"), F.array(F.lit("a")).alias("genres")), "dataset", **files.gaps({"genre": "genres"}))
    assert run["queue"]["rows"] == 0 and run["queue"]["attempts"] == 0
    report = json.loads(files.run_report(spark, {}, run["dataset"], run["queue"], {}).first().report)
    assert report["dataset"] == {"records": 0, "years": []} and report["field_coverage_percent"] == {"genre": 0.0}


def test_shards_are_pruned_by_the_addresses(spark, tmp_path):
    pages = spark.range(600).select("id", F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    folder = str(tmp_path / "pages")
    files.write_page_store(pages, folder)
    asked = pages.filter(F.col("url").endswith("/77"))
    found = files.read_pages(spark, folder, asked)
    assert [(r.id, r.html) for r in found.collect()] == [(77, "<p>77")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert len(set(Path(folder).glob("shard=*"))) > 100

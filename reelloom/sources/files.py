"""Catalogue files in and out: CSV, JSON, Parquet, reports, and the page store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

COLUMNS = ["movie_id", "movie_name", "year", "language", "genre", "cast", "director", "production_house", "music_director", "writer", "wikipedia_url"]
LISTS = ["genre", "cast", "director", "production_house", "music_director", "writer"]
REQUIRED = ["movie_name", "year"]
FLAT = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
NESTED = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in LISTS else T.StringType()) for c in COLUMNS])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flat file; missing required columns are an error, missing others are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files that each hold an array of objects with real arrays, or one object a line. A file whose top level is no array is an error."""
    if not lines:
        odd = spark.read.text(path, wholetext=True).filter(~F.col("value").rlike(r"^[\s\ufeff]*\["))
        if not odd.isEmpty():
            raise ValueError(f"a file under {path} holds no array")
    return spark.read.schema(NESTED).json(path, multiLine=not lines)


#: The names by which a field may come, first those that win.
ALIASES = {
    "genres": ["genres", "genre"], "actors": ["cast", "cast_members"], "directors": ["directors", "director"], "houses": ["production_houses", "production_house"],
    "music": ["music_directors", "music_director"], "writers": ["writers", "writer"],
}


def engine_works(rows: DataFrame) -> DataFrame:
    """movie_id, title, year and arrays from singular or plural fields, text or arrays; repeats stay, years lie in 1801 to 2199."""
    kinds = dict(rows.dtypes)
    none = F.array().cast("array<string>")

    def values(c: str) -> Column:
        return tx.plain_values(F.col(c)) if kinds[c] == "string" else F.filter(F.transform(c, lambda x: tx.trimmed(x.cast("string"))), lambda x: x != "")

    def first(names: list[str], give, default: Column) -> Column:
        found = default
        for n in reversed([n for n in names if n in kinds]):
            found = F.when(F.col(n).isNotNull(), give(n)).otherwise(found)
        return found

    text = lambda c: F.col(c).cast("string")
    return rows.select(
        first(["movie_id", "id"], lambda c: F.col(c).cast("long"), F.lit(0).cast("long")).alias("movie_id"),
        tx.trimmed(first(["movie_name", "title"], text, F.lit(""))).alias("title"),
        (tx.parse_year(F.col("year"), 1800, 2200) if "year" in kinds else F.lit(None).cast("int")).alias("year"),
        *[first(names, values, none).alias(c) for c, names in ALIASES.items()],
    )


def as_works(rows: DataFrame) -> DataFrame:
    """Rows of S1 or S2 as works with arrays (S3) and a parsed year."""
    kinds = dict(rows.dtypes)

    def values(c: str) -> Column:
        if kinds[c] == "string":
            return tx.multi_values(F.col(c))
        trimmed = F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), tx.trimmed), lambda x: x != "")
        return tx.ordered_distinct(trimmed, F.transform(trimmed, F.lower))

    plain = [tx.trimmed(F.col("movie_name")).alias("title"), tx.parse_year(F.col("year")).alias("year"), tx.trimmed(F.col("language")).alias("language"), tx.trimmed(F.col("wikipedia_url")).alias("url")]
    return rows.select(*plain, *[values(c).alias(n) for c, n in zip(LISTS, ["genres", "actors", "directors", "houses", "music", "writers"], strict=True)])


def flat_rows(works: DataFrame, language: str) -> DataFrame:
    """The eleven columns, arrays joined by pipes, nulls as empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    arrays = [F.coalesce(F.array_join(n, "|"), F.lit("")).alias(c) for c, n in zip(LISTS, ["genres", "actors", "directors", "houses", "music", "writers"], strict=True)]
    named = F.coalesce(F.nullif(text("language"), F.lit("")), F.lit(language)).alias("language")
    return works.select(text("movie_id").alias("movie_id"), text("title").alias("movie_name"), text("year").alias("year"), named, *arrays, text("url").alias("wikipedia_url"))


def write_csv(works: DataFrame, path: str, language: str) -> None:
    flat_rows(works, language).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(works: DataFrame, path: str) -> None:
    """One object a line, arrays kept."""
    works.write.mode("overwrite").json(path)


def normalised(works: DataFrame) -> dict[str, DataFrame]:
    """Movies without arrays of children, movie_genres, movie_cast (positions from 1)."""
    cast = works.select("movie_id", F.posexplode("actors").alias("p", "actor_name"))
    return {
        "movies": works.drop("genres", "actors"),
        "movie_genres": works.select("movie_id", F.explode("genres").alias("genre")),
        "movie_cast": cast.select("movie_id", "actor_name", (F.col("p") + 1).alias("cast_position")),
    }


def write_normalised(works: DataFrame, folder: str) -> None:
    for name, df in normalised(works).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def failed_report(queue: DataFrame) -> DataFrame:
    """Failed addresses with one-line errors, by year and name."""
    error = F.regexp_replace(F.coalesce("error", F.lit("")), r"[\r\n]+", " ")
    return queue.filter("status = 'failed'").select("name", "year", "url", "attempts", error.alias("error")).orderBy("year", "name", "url")


def missing_report(flagged: DataFrame) -> DataFrame:
    """Works with something missing, and a flag for each field."""
    flags = [c for c in flagged.columns if c.startswith("missing_")]
    return flagged.filter(F.greatest(*flags) == 1).select("movie_id", "title", "year", *flags)


def discrepancy_report(records: DataFrame) -> DataFrame:
    """S10."""
    return records.filter("year_discrepancy").select("title", "year", "box_year", F.array_join("notes", "; ").alias("notes"))


def rejected_report(graded: DataFrame) -> DataFrame:
    """What was not accepted, with its real reasons."""
    return graded.filter("NOT valid").select("id", "confidence", F.array_join("reasons", "; ").alias("reasons"))


class Run:
    """The counters of a run, taken by named metrics while its stages are written, so that no stage is read again to count it."""

    def __init__(self, folder: str):
        self.folder, self.seen = folder, {}

    def write(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """df written under its stage's name and read back; rows and the metrics, aggregates over its columns, are counted on the way."""
        watch = Observation(f"{stage}-{uuid.uuid4().hex}")
        named = {"rows": F.count(F.lit(1)), **metrics}
        df.observe(watch, *[c.alias(n) for n, c in named.items()]).write.mode("overwrite").parquet(f"{self.folder}/{stage}")
        self.seen[stage] = {n: watch.get.get(n) for n in named}
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/{stage}")

    def __getitem__(self, stage: str) -> dict:
        return self.seen[stage]


def states(**more: Column) -> dict[str, Column]:
    """Metrics of a work queue: rows by status, and attempts."""
    return {s: F.count_if(F.col("status") == s) for s in ("pending", "success", "failed")} | {"attempts": F.coalesce(F.sum("attempts"), F.lit(0))} | more


def gaps(fields: dict[str, str]) -> dict[str, Column]:
    """Metrics of a dataset: works without each field (a list column by its field's name), and the years."""
    return {f"missing_{f}": F.count_if(F.size(c) == 0) for f, c in fields.items()} | {"years": F.sort_array(F.collect_set("year"))}


def run_report(spark: SparkSession, run: dict, dataset: dict, database: dict, sources: dict) -> DataFrame:
    """One row, report: a JSON object of the run's counters, the dataset, the work queue, the coverage of fields and the source tables.

    Coverage is in percent, cut to one place; of no works it is 0.
    """
    missing = {n.removeprefix("missing_"): v for n, v in dataset.items() if n.startswith("missing_")}
    n = dataset["rows"]
    report = {
        "run": run,
        "dataset": {"records": n, "years": list(dataset["years"])},
        "database": database,
        "field_coverage_percent": {f: (1000 * (n - m) // n) / 10 if n else 0.0 for f, m in missing.items()},
        "missing_counts": missing,
        "sources": sources,
    }
    return spark.range(1).select(F.lit(json.dumps(report)).alias("report"))


def page_store(pages: DataFrame) -> DataFrame:
    """Pages with the two-letter fan-out of their address's digest, the column to partition by."""
    return pages.withColumn("shard", F.substring(F.sha2("url", 256), 1, 2))


def write_page_store(pages: DataFrame, folder: str) -> None:
    page_store(pages).repartition("shard").write.mode("append").partitionBy("shard").parquet(folder)


def read_pages(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """The stored pages of some addresses. Where urls is a filtered table that may be broadcast, Spark prunes the shards by it before it reads."""
    asked = urls.select("url", F.substring(F.sha2("url", 256), 1, 2).alias("shard"))
    return spark.read.parquet(folder).join(asked, ["url", "shard"], "left_semi")


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

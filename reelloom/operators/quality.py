"""Grading, validity, coverage, quality scores and eligibility of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

FIELDS = {"genre": "genres", "cast": "actors", "director": "directors", "production_house": "houses", "music_director": "music", "writer": "writers"}
LEAST_SCORE, LEAST_CAST, LEAST_GENRES = 6, 2, 1


def language_grade(language: Column, categories: Column, entity: Column, target: str, kind: str = r"\bfilms?\b") -> Column:
    """V1: struct<valid, confidence, signals, reasons>.

    categories is an array; entity says whether the page describes such a work; kind is the pattern
    by which a category says so.
    """
    by_category = F.exists(categories, lambda c: c.rlike(rf"(?i)\Q{target}\E[- ]language\s+films?"))
    mentions = ~by_category & F.exists(categories, lambda c: c.rlike(rf"(?i)\b\Q{target}\E\b"))
    has_kind = F.exists(categories, lambda c: c.rlike(f"(?i){kind}"))
    stated = F.lower(tx.clean_text(language))
    by_infobox = stated.contains(target.lower())
    other = (stated != "") & ~by_infobox
    is_work = F.coalesce(entity, F.lit(False)) | has_kind
    high, medium = by_category | (by_infobox & has_kind), by_infobox | mentions
    confidence = F.when(~is_work, "low").when(high, "high").when(medium, "medium").when(other, "low").otherwise("medium")
    signals = F.array_compact(
        F.array(
            F.when(by_category, "category:language"),
            F.when(by_infobox, "infobox:language").when(other, F.concat(F.lit("infobox:language="), stated)),
            F.when(F.coalesce(entity, F.lit(False)), "entity:work"),
            F.when(has_kind, "category:work"),
            F.when(mentions, "category:mention"),
        )
    )
    reasons = F.array_compact(
        F.array(
            F.when(~is_work, "not a work")
            .when(~high & ~medium & other, F.concat(F.lit("other language: "), stated))
            .when(~high & ~medium, "language inferred from list membership")
        )
    )
    return F.struct((confidence != "low").alias("valid"), confidence.alias("confidence"), signals.alias("signals"), reasons.alias("reasons"))


def validity(name: Column, year: Column, url_ok: Column, aggregate: Column, grade: Column, years: tuple[int, int]) -> Column:
    """V3: struct<valid, reasons>; every broken rule adds its reason."""
    lo, hi = years
    broken = F.array_compact(
        F.array(
            F.when(tx.clean_text(name) == "", "empty name"),
            F.when(aggregate, "aggregate page"),
            F.when(year.isNull(), "missing year").when(~year.between(lo, hi), F.concat(F.lit("year outside range: "), year.cast("string"))),
            F.when(~url_ok, "invalid url"),
        )
    )
    return F.struct((grade["valid"] & (F.size(broken) == 0)).alias("valid"), F.concat(grade["reasons"], broken).alias("reasons"))


def missing_flags(works: DataFrame) -> DataFrame:
    """V4: missing_<field> (0 or 1) and n_filled of the ten catalogue fields that are there."""
    flags = {f"missing_{f}": (F.size(c) == 0).cast("int") for f, c in FIELDS.items()}
    scalar = [c for c in ("title", "year", "language", "url") if c in works.columns]
    filled = sum([(F.size(c) > 0).cast("int") for c in FIELDS.values()], F.lit(0))
    for c in scalar:
        filled = filled + (F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0") == F.lit(False)).cast("int")
    return works.withColumns(flags | {"n_filled": filled})


def missing_counts(works: DataFrame) -> DataFrame:
    """V5 and V6: field, missing, coverage (percent, one place, half to even; 0.0 of nothing)."""
    counts = works.agg(F.count("*").alias("n"), *[F.count_if(F.size(c) == 0).alias(f) for f, c in FIELDS.items()])
    long = counts.unpivot(["n"], list(FIELDS), "field", "missing")
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.bround(100.0 * (F.col("n") - F.col("missing")) / F.greatest("n", F.lit(1)), 1))
    return long.select("field", "missing", share.alias("coverage"))


def quality_score() -> Column:
    """V8: 0 to 8, a cast of two or more counted double."""
    one = lambda c: F.when(c, 1).otherwise(0)
    score = one(F.coalesce(F.col("year"), F.lit(0)) != 0) + F.when(F.size("actors") >= 2, 2).when(F.size("actors") == 1, 1).otherwise(0)
    for c in ("genres", "directors", "houses", "music", "writers"):
        score = score + one(F.size(c) > 0)
    return score


def is_eligible(score: Column, least_score: int = LEAST_SCORE, least_cast: int = LEAST_CAST, least_genres: int = LEAST_GENRES) -> Column:
    """V9."""
    there = (F.coalesce(F.col("year"), F.lit(0)) != 0) & (F.size("directors") > 0)
    return there & (F.size("actors") >= least_cast) & (F.size("genres") >= least_genres) & (score >= least_score)


def graded(works: DataFrame) -> DataFrame:
    return works.withColumn("score", quality_score()).withColumn("eligible", is_eligible(F.col("score")))


def catalogue_counts(works: DataFrame) -> DataFrame:
    """V10."""
    return graded(works).agg(F.count("*").alias("works"), F.count_if("eligible").alias("eligible"))


def import_summary(rows: DataFrame, existing: DataFrame, first_problems: int = 10) -> DataFrame:
    """Counts over classified rows (seq, title, year, key and the arrays), and the first problems by seq."""
    bad = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "empty name").when(F.col("year").isNull(), "bad year")
    marked = graded(rows).withColumn("problem", bad)
    order = Window.partitionBy("key", "year").orderBy("seq")
    valid = marked.filter("problem IS NULL").withColumn("n", F.row_number().over(order))
    old = existing.select("key", "year", F.lit(True).alias("known")).distinct()
    kept = valid.join(old, ["key", "year"], "left")
    first = F.col("n") == 1
    counts = kept.agg(
        F.count_if(first & F.col("known").isNull()).alias("imported"),
        F.count_if(first & F.col("known").isNotNull()).alias("updated"),
        F.count_if(~first).alias("duplicates"),
        F.coalesce(F.sum(F.when(first, F.size("genres"))), F.lit(0)).alias("genre_rows"),
        F.coalesce(F.sum(F.when(first, F.size("actors"))), F.lit(0)).alias("cast_rows"),
        F.count_if(first & F.col("eligible")).alias("eligible"),
    )
    wrong = marked.filter("problem IS NOT NULL").select("seq", "problem")
    shown = wrong.orderBy("seq").limit(first_problems).agg(F.sort_array(F.collect_list(F.struct("seq", "problem"))).alias("p"))
    listed = shown.select(F.array_join(F.transform("p", lambda x: F.concat(F.lit("row "), x["seq"].cast("string"), F.lit(": "), x["problem"])), "; ").alias("problems"))
    return counts.join(wrong.agg(F.count("*").alias("invalid")).join(listed, how="cross"), how="cross")


def year_slice(works: DataFrame, start: int, end: int, bounds: tuple[int, int], year: int | None = None) -> DataFrame:
    """Works of a range of years; one year overrides it."""
    lo, hi = (year, year) if year is not None else (start, end)
    if lo > hi:
        raise ValueError(f"start year {lo} is after end year {hi}")
    if lo < bounds[0] or hi > bounds[1]:
        raise ValueError(f"years must lie in {bounds[0]} to {bounds[1]}")
    return works.filter(F.col("year").between(lo, hi))

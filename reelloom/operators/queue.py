"""Work-queue analytics over an append-only attempt log (url, year, name, seq, ts, outcome, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ERROR = 1000


def state(attempts: DataFrame) -> DataFrame:
    """One row a url: last status, attempts (those with an outcome), last_attempt, error of a last failure, cut to 1000."""
    tried = F.col("outcome") != "pending"
    last = F.max_by(F.struct("outcome", "error"), F.when(tried, F.col("seq")))
    rows = attempts.groupBy("url").agg(
        F.min("year").alias("year"),
        F.min("name").alias("name"),
        last.alias("x"),
        F.count_if(tried).alias("attempts"),
        F.max(F.when(tried, F.col("ts"))).alias("last_attempt"),
    )
    status = F.coalesce("x.outcome", F.lit("pending"))
    error = F.when(status == "failed", F.substring("x.error", 1, MOST_ERROR))
    return rows.select("url", "year", "name", status.alias("status"), "attempts", "last_attempt", error.alias("error"))


def _years(df: DataFrame, years: list[int] | None) -> DataFrame:
    return df.filter(F.col("year").isin(years)) if years else df


def pending(queue: DataFrame, years: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """W1."""
    found = _years(queue.filter("status = 'pending'"), years).orderBy("year", "name", "url")
    return found.limit(limit) if limit else found


def failed(queue: DataFrame, years: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """W2."""
    found = _years(queue.filter("status = 'failed'"), years).orderBy("attempts", "year", "url")
    return found.limit(limit) if limit else found


def successful(queue: DataFrame, years: list[int] | None = None) -> DataFrame:
    """W2."""
    return _years(queue.filter("status = 'success'"), years).orderBy("year", "name", "url")


def by_year(queue: DataFrame) -> DataFrame:
    """W3."""
    return queue.groupBy("year").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )


def requeue_failed(queue: DataFrame) -> DataFrame:
    """W5."""
    return queue.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))

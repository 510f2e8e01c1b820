"""Deterministic selection by date: salted digests order a pool, the day indexes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_seed(date: Column, salt: str) -> Column:
    """The digest as hex; it does not fit a number."""
    return F.sha2(F.concat(F.lit(salt), F.lit("-"), date.cast("string")), 256)


def _placed(pool: DataFrame, salt: str, id_col: str, digits: int) -> tuple[DataFrame, DataFrame]:
    """pool with its digest and bin (the digest's first digits), and bin, before: counts of the bins before each.

    Digests are uniform, so the bins are even and no task orders more than one of them.
    """
    digest = pool.withColumn("digest", F.sha2(F.concat_ws(":", F.lit(salt), F.col(id_col)), 256))
    binned = digest.withColumn("bin", F.substring("digest", 1, digits))
    sizes = binned.groupBy("bin").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** digits rows at most
    return binned, sizes.select("bin", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def shuffled(pool: DataFrame, salt: str, id_col: str = "movie_id", digits: int = 3) -> DataFrame:
    """Pool in the order of sha256("salt:id"), place from 0, with no global sort in one task."""
    binned, before = _placed(pool, salt, id_col, digits)
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("digest", id_col)) - 1
    ranked = binned.withColumn("rank", rank).join(before, "bin")
    return ranked.withColumn("place", (F.col("before") + F.col("rank")).cast("long")).drop("bin", "digest", "n", "before", "rank")


def at_places(pool: DataFrame, places: DataFrame, salt: str, id_col: str = "movie_id", digits: int = 3) -> DataFrame:
    """place, id of the asked places (column place) in the order of shuffled; only the bins that hold one of them are dealt out and ordered."""
    binned, before = _placed(pool.select(id_col), salt, id_col, digits)
    inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
    asked = places.select("place").distinct().join(F.broadcast(before), inside).select("bin", "before").distinct()
    ordered = binned.join(F.broadcast(asked), "bin")  # 16 ** digits rows at most, as above
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("digest", id_col)) - 1
    return ordered.select((F.col("before") + rank).cast("long").alias("place"), id_col)


def daily_picks(dates: DataFrame, pool: DataFrame, salt: str, epoch: str, id_col: str = "movie_id") -> DataFrame:
    """game_date, id for each date; no repeats within a pass, wrapping before the epoch; null from an empty pool."""
    size = pool.agg(F.count("*").alias("n"))
    days = F.when(F.col("n") > 0, F.pmod(F.datediff("game_date", F.lit(epoch).cast("date")), F.col("n")))
    asked = dates.join(F.broadcast(size), how="cross").withColumn("place", days.cast("long"))  # one row
    return asked.join(at_places(pool, asked, salt, id_col), "place", "left").select("game_date", id_col)


def with_pinned(computed: DataFrame, pinned: DataFrame, id_col: str = "movie_id") -> DataFrame:
    """A pick that was pinned wins."""
    fixed = pinned.select("game_date", F.col(id_col).alias("_pinned"))
    return computed.join(fixed, "game_date", "left").select("game_date", F.coalesce("_pinned", id_col).alias(id_col), F.col("_pinned").isNotNull().alias("pinned"))


def first_places(pool: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order, numbered; a top-k, then one task of n rows."""
    return pool.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)

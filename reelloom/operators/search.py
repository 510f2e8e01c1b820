"""Ranked title search, for one query or a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_parts, search_key
from ..session import cut

LIMIT = 12


def _match(text: Column) -> tuple[Column, Column]:
    compact = F.replace(text, F.lit(" "), F.lit(""))
    squeezed = F.replace(F.col("key"), F.lit(" "), F.lit(""))
    hit = F.col("key").contains(text) | ((compact != text) & squeezed.contains(compact))
    rank = F.when((F.col("key") == text) | (squeezed == compact), 0).when(F.col("key").startswith(text), 1).otherwise(2)
    return hit, rank


def _order() -> list[Column]:
    return [F.col("rank"), F.length("key"), F.col("year").desc_nulls_last(), F.col("title"), F.col("id")]


def search(titles: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Q1: id, title, year, rank of the best titles (id, title, key, year): exact, prefix, elsewhere; then short, new, by title and id."""
    parts = titles.sparkSession.range(1).select(query_parts(F.lit(query)).alias("q")).first().q
    if not parts.text:
        return titles.limit(0).select("id", "title", "year", F.lit(0).alias("rank"))
    hit, rank = _match(F.lit(parts.text))
    found = titles.filter(hit)
    if parts.year is not None:
        found = found.filter(F.col("year") == parts.year)
    return found.withColumn("rank", rank).orderBy(*_order()).limit(limit).select("id", "title", "year", "rank")


#: Stands for "any year" where asks meet titles.
ANY_YEAR = -1


def _pieces(c: Column, size: int) -> Column:
    n = F.length(c)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: c.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _best_titles(titles: DataFrame, years: DataFrame, limit: int) -> DataFrame:
    """key, tag, id, title, year: the first titles of each key, over all years and in each year asked for; each task reduces its own first."""
    order = [F.col("title"), F.col("id")]
    slim = titles.select("key", "year", "title", "id")
    dated = slim.join(F.broadcast(years), F.col("year") == F.col("tag"))
    found = []
    for rows, newest in ((slim.withColumn("tag", F.lit(ANY_YEAR)), [F.col("year").desc_nulls_last()]), (dated, [])):
        w = Window.partitionBy("key", "tag").orderBy(*newest, *order)
        found.append(rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select("key", "tag", "id", "title", "year"))
    return found[0].unionByName(found[1])


def batch_search(titles: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Q2: query_id, place, id, rank for each row of queries (query_id, query).

    Different asks (text, year) meet different keys once, however many queries and titles share them.
    They meet on a three-letter piece: a key takes all its pieces, with and without spaces, an ask
    only the one that fewest keys hold, so a common piece meets none but asks that have no other; an
    ask shorter than three letters is matched against pieces of its own length. Of what meets, only
    keys up to the limit-th by rank and length go on, and only those fetch titles, of which no key
    holds more than the limit. A key matches an ask with a year only if it has a title of that year;
    such asks name 1900 to 2099, so their years may be sent to every task. The answers are fanned
    out to the queries at the end.
    """
    asked = queries.withColumn("q", query_parts(F.col("query"))).select("query_id", F.col("q.text").alias("text"), F.coalesce("q.year", F.lit(ANY_YEAR)).alias("tag")).filter("text <> ''")
    asks = cut(asked.select("text", "tag").distinct())
    years = asks.select("tag").distinct().filter(F.col("tag") != ANY_YEAR)

    keys = titles.select("key").distinct()
    squeezed = F.replace(F.col("key"), F.lit(" "), F.lit(""))
    own = F.array_distinct(F.concat(*[_pieces(c, size) for c in (F.col("key"), squeezed) for size in (1, 2, 3)]))
    lists = keys.select("key", F.explode(own).alias("piece"))
    counts = lists.groupBy("piece").agg(F.count("*").alias("n"))
    forms = asks.select("text", F.explode(F.array_distinct(F.array("text", F.replace("text", F.lit(" "), F.lit(""))))).alias("form")).distinct()
    form = F.col("form")
    probes = forms.withColumn("piece", F.explode(F.when(F.length(form) < 3, F.array(form)).otherwise(_pieces(form, 3)))).join(counts, "piece", "left")
    probes = probes.groupBy("text", "form").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece")).select("text", "piece").distinct()

    hit, rank = _match(F.col("text"))
    met = lists.join(probes, "piece").filter(hit).select("text", "key", rank.alias("rank")).distinct()
    dated = titles.join(F.broadcast(years), F.col("year") == F.col("tag"), "left_semi").select("key", F.col("year").alias("tag")).distinct()
    any_year = met.join(asks.filter(F.col("tag") == ANY_YEAR), "text")
    of_year = met.join(dated, "key").join(asks, ["text", "tag"])
    near = Window.partitionBy("text", "tag").orderBy("rank", F.length("key"))
    both = any_year.unionByName(of_year.select(*any_year.columns)).withColumn("_n", F.rank().over(near)).filter(F.col("_n") <= limit)

    held = both.join(_best_titles(titles, years, limit), ["key", "tag"])
    w = Window.partitionBy("text", "tag").orderBy(*_order())
    answers = held.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("text", "tag", "place", "id", "rank")
    return asked.join(answers, ["text", "tag"]).select("query_id", "place", "id", "rank")


def catalogue(titles: DataFrame) -> DataFrame:
    """Q3."""
    return titles.select("id", "title", "key", "year").orderBy("id")


def not_guessed(candidates: DataFrame, guessed: DataFrame, keys: list[str]) -> DataFrame:
    """Q4."""
    return candidates.join(guessed.select(*keys).distinct(), keys, "left_anti")


def with_search_key(works: DataFrame) -> DataFrame:
    return works.withColumn("key", search_key(F.col("title")))

"""Order-aware dedup, merge, upsert, anti-joins and gap filling.

Input order is data: every "first" is taken by a total order column seq, never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut


def first_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key; n_seen counts the rows of the key. A key's rows are reduced before the shuffle."""
    return best_by(df, keys, [F.col(order).isNull(), F.col(order)], "n_seen")


def best_by(df: DataFrame, keys: list[str], order: list[Column], count: str) -> DataFrame:
    """The least row of each key by an order, and the number of its rows."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row"), F.count("*").alias(count))
    return found.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns], count)


def canonical_key(df: DataFrame, key: str, year: str, url: str, order: str = "seq") -> DataFrame:
    """df and ckey: a row's own key, or that of the first row with its url if their years agree.

    The first row of a url is found by an aggregate and joined back, one row a url, so a url of very many
    rows is reduced before the shuffle and its join is one that Spark may split. Rows without a url
    take no part; each has a join key of its own, so that the missing url is no hot key.
    """
    df = df.withColumn("_url", F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "#.*$", ""))
    named = df.filter("_url <> ''").groupBy("_url").agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(year).alias("y")), order).alias("_first"))
    spread = F.when(F.col("_url") == "", F.concat(F.lit("\x00"), F.col(order).cast("string"))).otherwise(F.col("_url"))
    found = df.withColumn("_url", spread).join(named, "_url", "left")
    same = F.col("_first").isNotNull() & F.col("_first.y").eqNullSafe(F.col(year))
    return found.withColumn("ckey", F.when(same, F.col("_first.k")).otherwise(F.col(key))).drop("_url", "_first")


def merge_candidates(df: DataFrame, key: str, year: str, url: str, fields: list[str], order: str = "seq") -> DataFrame:
    """One row a canonical key and year, each field from its first row that fills it."""
    keyed = canonical_key(df, key, year, url, order)

    def first_filled(c: str) -> Column:
        array = keyed.schema[c].dataType.typeName() == "array"
        there = F.size(c) > 0 if array else F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
        return F.min_by(F.col(c), F.when(there, F.col(order))).alias(c)

    return keyed.groupBy("ckey", year).agg(F.min(order).alias(order), F.count("*").alias("n_merged"), *[first_filled(c) for c in fields])


def richest(df: DataFrame, key: str, year: str, url: str, filled: str, order: str = "seq") -> DataFrame:
    """D3: the row of each canonical key and year with most fields, ties to the earliest; n_rows of the key."""
    return best_by(canonical_key(df, key, year, url, order), ["ckey", year], [-F.col(filled), F.col(order)], "n_rows")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Incoming rows replace existing ones of their key and keep the id; new keys get ids after the largest.

    action is kept, updated or inserted. New ids are given by `number`.
    """
    values = [c for c in existing.columns if c not in (*keys, id_col)]
    old = existing.select(*keys, F.col(id_col).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in values])
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_new"))
    both = old.join(new, keys, "full_outer")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNotNull(), "updated").otherwise("inserted")
    # Kept, since it is asked three times: for its new keys, for the largest id, and as a whole.
    joined = cut(both.select(*keys, "_old", action.alias("action"), *[F.when(F.col("_new").isNull(), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c) for c in values]))
    fresh = number(joined.filter("action = 'inserted'"), keys, "_rank")
    top = joined.agg(F.coalesce(F.max("_old"), F.lit(0)).alias("_top"))
    ids = fresh.join(F.broadcast(top), how="cross").withColumn(id_col, (F.col("_top") + F.col("_rank")).cast("long"))  # one row
    rest = joined.filter("action <> 'inserted'").withColumn(id_col, F.col("_old").cast("long"))
    out = [id_col, *keys, *values, "action"]
    return rest.select(*out).unionByName(ids.select(*out))


def number(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Ids 1..n in the order of the columns, nulls first, with no global sort in one task.

    Rows are range-partitioned by all the columns and sorted there; a row's place in its partition is
    added to the counts of the partitions before it. The sorted rows are kept, so counts and
    places come from the same partitions.
    """
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    low = (1 << 33) - 1  # the id's lower bits number the rows of a partition
    placed = held.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit(low)) + 1})
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_r")).drop("_m", "_part", "_r", "_before")


def enqueue(queue: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming whose key the queue lacks, one a key (the first by seq)."""
    return first_by(incoming, [key]).join(queue.select(key).distinct(), key, "left_anti")


def resolve_aliases(titles: DataFrame, aliases: DataFrame, existing: DataFrame, hops: int = 4) -> DataFrame:
    """Title, target: edges followed hops times at most; null if the end does not exist.

    A redirect overrides a normalisation from the same title.
    """
    edges = first_by(aliases.withColumn("seq", F.when(F.col("kind") == "redirect", 0).otherwise(1)), ["from"]).select("from", "to")
    now = titles.select("title").distinct().withColumn("target", F.col("title"))
    for _ in range(hops):
        now = now.join(edges, F.col("target") == F.col("from"), "left").select("title", F.coalesce("to", "target").alias("target"))
    known = existing.select(F.col("title").alias("target")).distinct().withColumn("_there", F.lit(True))
    return now.join(known, "target", "left").select("title", F.when(F.col("_there"), F.col("target")).alias("target"))


def resolve_by_patterns(candidates: DataFrame, aliases: DataFrame, existing: DataFrame, patterns: list[str]) -> DataFrame:
    """Seq, name, year, target: the first pattern ({name}, {year}) whose title resolves to a plausible page."""
    forms = []
    for i, p in enumerate(patterns):
        text = F.lit(p)
        text = F.replace(F.replace(text, F.lit("{name}"), F.col("name")), F.lit("{year}"), F.coalesce(F.col("year").cast("string"), F.lit("")))
        forms.append(F.struct(F.lit(i).alias("rank"), text.alias("title")))
    tried = candidates.select("seq", "name", "year", F.explode(F.array(*forms)).alias("f")).select("seq", "name", "year", "f.*")
    found = tried.join(resolve_aliases(tried, aliases, existing), "title").filter(tx.is_plausible(F.col("target"), F.col("name")))
    best = found.groupBy("seq").agg(F.min_by("target", "rank").alias("target"))
    return candidates.join(best, "seq", "left").select("seq", "name", "year", "target")


def first_hit(hits: DataFrame, year: Column, word: str) -> DataFrame:
    """Query, title: the first search hit by rank that names the year and the word."""
    fits = hits.filter(F.col("title").contains(year.cast("string")) & F.lower("title").contains(word.lower()))
    return fits.groupBy("query").agg(F.min_by("title", "rank").alias("title"))


def fill_gaps(works: DataFrame, credits: DataFrame, fields: list[str], source: str, most_cast: int = 10) -> DataFrame:
    """Empty arrays of works filled from the best match (least rank) of credits by key and year; filled lists which."""
    best = best_by(credits.select("key", "year", "rank", *fields), ["key", "year"], [F.col("rank")], "_n").select("key", "year", *[F.col(f).alias(f"_c_{f}") for f in fields])
    joined = works.join(best, ["key", "year"], "left")
    offered = {f: F.coalesce(F.slice(f"_c_{f}", 1, most_cast) if f == "actors" else F.col(f"_c_{f}"), F.array().cast("array<string>")) for f in fields}
    takes = {f: (F.size(f) == 0) & (F.size(offered[f]) > 0) for f in fields}
    filled = F.array_compact(F.array(*[F.when(takes[f], f) for f in fields]))
    sources = F.when(F.size(filled) > 0, F.array(F.lit("primary"), F.lit(source))).otherwise(F.array(F.lit("primary")))
    return joined.withColumns({"filled": filled, "sources": sources} | {f"_f_{f}": F.when(takes[f], offered[f]).otherwise(F.col(f)) for f in fields}).select(
        *[F.col(f"_f_{c}").alias(c) if c in fields else F.col(c) for c in works.columns], "filled", "sources"
    )


def fill_release_date(works: DataFrame, claims: Column) -> DataFrame:
    """release_date, where empty, from the first claim (array of ISO-like strings) with a date; year only if missing."""
    valid = F.filter(F.transform(claims, tx.iso_date), lambda d: d != "")
    given = F.get(valid, F.lit(0))
    take = (F.coalesce("release_date", F.lit("")) == "") & given.isNotNull()
    return works.withColumns(
        {
            "release_date": F.when(take, given).otherwise(F.col("release_date")),
            "year": F.when(take & F.col("year").isNull(), F.substring(given, 1, 4).cast("int")).otherwise(F.col("year")),
            "filled": take,
        }
    )


def rebuild_arrays(works: DataFrame, children: DataFrame, id_col: str, pos: str, value: str, name: str) -> DataFrame:
    """The ordered array of each work from its child rows; empty where there are none."""
    lists = children.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("_x"))
    found = F.coalesce(F.col(f"_x.{value}"), F.array().cast("array<string>"))
    return works.join(lists, id_col, "left").withColumn(name, found).drop("_x")


def rejects(everything: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """D15."""
    return everything.join(valid.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """The last values of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_x")).select(key, "_x.*")

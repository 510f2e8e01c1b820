"""Mixing sources to target weights: whole copies that are certain, then Pareto order sampling.

Each document has a size measure, by default the number of binary digits of its word count, so
longer documents are wanted more, though not in proportion. A source with target T owes its documents
m = min(most, c * measure) copies each, where c is such that the expected words, the sum of m times
the words, are T; c follows from one row for each value of the measure. The whole part of m is given
for certain. The rest is an inclusion probability p, different from document to document, and
documents are ranked by (u/(1-u)) / (p/(1-p)) with u a uniform number drawn from the document
itself; a fixed size in words is taken from the top of that order: a document is in while the middle
of its words lies within what is left of the target, so the source misses it by at most half a document.

No source is sorted as one group. The ranks fall into RANK_BINS bins whose sizes are summed
before the shuffle; running sums over the bins show the one bin a source's cut falls into, and
only that bin's documents are sorted, equal ones as one row. What is joined to the documents is one
row for each source and value of the measure, so no text and no document outside those bins is shuffled.

Defined results: a null text has size 0 and takes 0 words; a null source is a source, last in
order; a source without any word gives no copies; u depends on the id, the source and the text, so
reruns agree, and rows that are equal in all three are equal candidates: they share what the cut
leaves them. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, count_words, cut, table

RANK_BINS = 16384
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from source, size. One row a source from here on.

    Shares are proportional to the weights; a target stops at most * source_size, and what is
    left over is shared again. Sorted by that limit over the weight, the sources that stop are
    the first ones, so the common level is found with running sums.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = named.withColumn("place", place).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    rows = rows.withColumn("level", level).withColumn("stops", F.col("ratio") <= F.col("level"))
    common = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return rows.withColumn("common", common).select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def bits(size: Column) -> Column:
    """The size measure: the number of binary digits of the word count, 1 for none."""
    return F.length(F.bin(size)).cast("long")


def shares(classes: DataFrame, goal: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, measure, source_size, target, whole, p, rest from classes (source, measure, words) and targets.

    Classes whose documents get the most copies are those of the largest measures, so the common
    factor c is found with running sums, as the level is in `targets`.
    """
    rows = classes.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    own = Window.partitionBy("source")
    before = own.orderBy(F.desc("measure")).rowsBetween(Window.unboundedPreceding, -1)
    onwards = own.orderBy(F.desc("measure")).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "owed": F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(before), F.lit(0)),
            "weight": F.sum(F.col("words") * F.col("measure")).over(onwards),
        }
    )
    rows = rows.withColumn("stops", F.col("measure") * F.col("owed") >= F.lit(most) * F.col("weight"))
    factor = F.max(F.when(~F.col("stops"), F.try_divide(F.col("owed"), F.col("weight")))).over(own)
    per_copy = F.when(F.col("source_size") == 0, 0.0).when(F.col("stops"), float(most)).otherwise(F.least(F.col("factor") * F.col("measure"), F.lit(float(most))))
    rows = rows.withColumn("factor", factor).withColumn("per_copy", per_copy).withColumn("whole", F.floor("per_copy"))
    return rows.select(
        "source",
        "measure",
        "source_size",
        "target",
        "whole",
        (F.col("per_copy") - F.col("whole")).alias("p"),
        (F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own)).alias("rest"),
    )


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _drawn(docs: DataFrame, measure, seed: int) -> DataFrame:
    """docs and _mix_size, _mix_measure, _mix_u."""
    u = uniform(F.col("doc_id"), F.col("source"), F.col("text"), seed=seed)
    return docs.withColumns({"_mix_size": count_words(F.col("text")), "_mix_u": u}).withColumn("_mix_measure", measure(F.col("_mix_size")))


def _ranked(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """drawn and the columns of plan, whose names begin with _p_; _mix_rank, and _mix_bin where p is above 0."""
    joined = drawn.join(plan, F.col("source").eqNullSafe(F.col("_p_source")) & (F.col("_mix_measure") == F.col("_p_measure")))
    rank = F.when(F.col("_p_p") > 0, _odds(F.col("_mix_u")) / _odds(F.col("_p_p")))
    return joined.withColumn("_mix_rank", rank).withColumn("_mix_bin", F.floor(F.col("_mix_rank") / (1 + F.col("_mix_rank")) * RANK_BINS))


def _prefixed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"_p_{c}") for c in rows.columns])


EDGE = ["source", "doc_id", "_mix_u", "_mix_size"]


def _planned(docs: DataFrame, weights: tuple[int, ...], most: int, measure, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The drawn ids and sizes; the plan, one row a source and measure, with _p_edge_bin; and, of the documents
    in those bins, one row for each set of equals with their number n and how many of them get a copy more."""
    drawn = cut(_drawn(docs.select("doc_id", "source", "text"), measure, seed).drop("text"))
    classes = cut(drawn.groupBy("source", F.col("_mix_measure").alias("measure")).agg(F.sum("_mix_size").alias("words")))
    goal = targets(classes.select("source", F.col("words").alias("size")), weights, most)
    plan = broadcast_if_small(cut(_prefixed(shares(classes, goal, most))))
    bins = _ranked(drawn, plan).filter("_p_p > 0").groupBy("source", "_mix_bin").agg(F.sum("_mix_size").alias("words"), F.max("_p_rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("_mix_bin").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        bins.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .select(F.col("source").alias("_e_source"), F.col("_mix_bin").alias("_p_edge_bin"), F.col("before").alias("_p_before"))
    )
    edged = broadcast_if_small(cut(plan.join(edges, F.col("_p_source").eqNullSafe(F.col("_e_source")), "left").drop("_e_source")))
    close = _ranked(drawn, edged).filter("_mix_bin = _p_edge_bin").groupBy(*EDGE, "_mix_rank", "_p_before", "_p_rest").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("_mix_rank", "doc_id", "_mix_u", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("_mix_size")
    close = close.withColumn("start", F.col("_p_before") + F.coalesce(F.sum(F.col("n") * size).over(order), F.lit(0)))
    first = F.col("start") + size - size / 2 <= F.col("_p_rest")
    several = F.when(size == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.try_divide(F.col("_p_rest") - F.col("start"), size) + 0.5)))
    more = F.when(~first, F.lit(0)).when(F.col("n") == 1, F.lit(1)).otherwise(several).cast("long")
    return drawn, edged, cut(close.select(*EDGE, "n", more.alias("more")))


def _clear(ranked: DataFrame) -> DataFrame:
    """The rows outside the bins of the cut, with their copies."""
    at_edge = F.coalesce(F.col("_mix_bin") == F.col("_p_edge_bin"), F.lit(False))
    extra = F.coalesce((F.col("_mix_bin") < F.col("_p_edge_bin")).cast("int"), F.lit(0))
    return ranked.filter(~at_edge).withColumn("_mix_copies", (F.col("_p_whole") + extra).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, measure=bits, seed: int = 42) -> DataFrame:
    """doc_id, source, u, size, source_size, target, copies, taken of every row."""
    drawn, plan, close = _planned(docs, weights, most, measure, seed)
    edge = close.select(*EDGE, "more", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    edge = _ranked(edge.withColumn("_mix_measure", measure(F.col("_mix_size"))), plan)
    edge = edge.withColumn("_mix_copies", (F.col("_p_whole") + (F.col("k") <= F.col("more")).cast("int")).cast("long"))
    columns = ["doc_id", "source", "_mix_u", "_mix_size", "_p_source_size", "_p_target", "_mix_copies"]
    found = _clear(_ranked(drawn, plan)).select(*columns).unionByName(edge.select(*columns))
    return found.toDF("doc_id", "source", "u", "size", "source_size", "target", "copies").withColumn("taken", F.col("copies") * F.col("size"))


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, measure=bits, seed: int = 42) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as the mix takes it, all columns kept.

    Each row is decided where it stands; only rows in a cut's bin meet the decisions on them.
    """
    _, plan, close = _planned(docs, weights, most, measure, seed)
    ranked = _ranked(_drawn(docs, measure, seed), plan)
    met = close.select(*[F.col(c).alias(f"_c_{c}") for c in EDGE], F.col("n").alias("_c_n"), F.col("more").alias("_c_more"))
    same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in EDGE]
    at_edge = ranked.filter("_mix_bin = _p_edge_bin").join(broadcast_if_small(met), (same[0] & same[1] & same[2] & same[3]))
    part = (F.col("_c_more") > 0) & (F.col("_c_more") < F.col("_c_n"))
    alike = at_edge.filter(~part).withColumn("_mix_copies", (F.col("_p_whole") + (F.col("_c_more") > 0).cast("int")).cast("long"))
    # Equals of which some get a copy more: rows alike in full become one with a number, the others take turns.
    told = at_edge.filter(part).withColumn("_mix_row", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    keys = [f"_c_{c}" for c in EDGE]
    counts = told.groupBy(*keys, "_mix_row").agg(F.count("*").alias("_mix_n"))
    earlier = Window.partitionBy(*keys).orderBy("_mix_row").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"_n{k}") for k in keys], F.col("_mix_row").alias("_n_row"), "_mix_n", "_mix_before")
    on = [F.col(k).eqNullSafe(F.col(f"_n{k}")) for k in keys]
    one = told.dropDuplicates([*keys, "_mix_row"]).join(counts, on[0] & on[1] & on[2] & on[3] & (F.col("_mix_row") == F.col("_n_row")))
    share = F.greatest(F.lit(0), F.least(F.col("_mix_n"), F.col("_c_more") - F.col("_mix_before")))
    dealt = one.withColumn("_mix_copies", (F.col("_p_whole") * F.col("_mix_n") + share).cast("long"))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], F.col("_mix_copies")]
    kept = _clear(ranked).select(*columns).unionByName(alike.select(*columns)).unionByName(dealt.select(*columns)).filter("_mix_copies > 0")
    return kept.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (CAST('0x' || substr(md5(concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0)))), 1, 13) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, place % 3 + 1 AS weight, source_size * 3 AS most, (source_size * 3)::DOUBLE / (place % 3 + 1)::DOUBLE AS ratio FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN most::DOUBLE ELSE (max(level) FILTER (ratio > level) OVER ()) * weight END AS target
  FROM levels),
classes AS (
  SELECT s.source, len(bin(s.size)) AS measure, CAST(sum(s.size) AS BIGINT) AS words, any_value(g.source_size) AS source_size, any_value(g.target) AS target
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, len(bin(s.size))),
owed AS (
  SELECT *, target - 3 * coalesce(CAST(sum(words) OVER before AS BIGINT), 0) AS owed, CAST(sum(words * measure) OVER onwards AS BIGINT) AS weight
  FROM classes
  WINDOW before AS (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onwards AS (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
factors AS (
  SELECT *, measure * owed >= 3 * weight AS stops, max(CASE WHEN measure * owed >= 3 * weight THEN NULL ELSE owed / nullif(weight, 0) END) OVER (PARTITION BY source) AS factor FROM owed),
shares AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN stops THEN 3 ELSE least(factor * measure, 3) END::DOUBLE AS per_copy FROM factors),
plan AS (
  SELECT *, floor(per_copy) AS whole, per_copy - floor(per_copy) AS p, target - sum(floor(per_copy) * words) OVER (PARTITION BY source) AS rest FROM shares),
odds AS (
  SELECT s.doc_id, s.source, s.size, s.u, p.source_size, p.target, p.whole, p.p, p.rest
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source AND len(bin(s.size)) = p.measure),
cumulated AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, u, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM (SELECT * FROM odds WHERE p > 0) UNION ALL BY NAME SELECT *, NULL AS middle FROM odds WHERE NOT p > 0)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cumulated
"""

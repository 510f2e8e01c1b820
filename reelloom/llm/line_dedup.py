"""Line dedup by overlapping windows of three lines.

The lines that hold a word, in order, form windows of three. A window is known by two 64-bit
hashes. Windows are counted before the shuffle; those found twice or more anywhere are joined back
to their places, and every place but the first (by doc_id, then text hash, then line) is removed:
the covered positions of a document are merged and what lies between them is kept. A hot window
is one row after counting; such rows, of bounded number, are broadcast to its places, which stay where they are.

Defined results: null and blank texts have no windows and stay as they are; documents of fewer
than three lines with a word lose none; blank lines are no part of a window and stay; null
doc_ids come first in order; rows that agree in doc_id and text are one document and are treated
alike, so a repeated row does not empty its twin. An empty table gives an empty result. All
columns are kept; text is the only one changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, join_by_count, table

#: A line is told by two hashes of different seeds.
OTHER_SEED = 7


def windows(docs: DataFrame) -> DataFrame:
    """d, t, p0, p1, p2, a, b: each window's document, its lines' positions and its two hashes."""
    lines = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(OTHER_SEED), x).alias("b"), x.rlike(WORD).alias("w")),
        ),
        lambda x: x["w"],
    )
    held = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), lines.alias("lines")).filter("text is not null")
    n = F.greatest(F.size("lines") - 2, F.lit(0))
    pairs = F.zip_with(
        F.slice("lines", F.lit(1), n),
        F.slice("lines", F.lit(2), n),
        lambda x, y: F.struct(x["i"].alias("p0"), y["i"].alias("p1"), F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"]).alias("b")),
    )
    triples = F.zip_with(
        pairs,
        F.slice("lines", F.lit(3), n),
        lambda x, z: F.struct(x["p0"].alias("p0"), x["p1"].alias("p1"), z["i"].alias("p2"), F.xxhash64(x["a"], z["a"]).alias("a"), F.xxhash64(x["b"], z["b"]).alias("b")),
    )
    return held.select("d", "t", F.explode(triples).alias("w")).select("d", "t", "w.*")


def covered(docs: DataFrame) -> DataFrame:
    """d, t, gone: the sorted positions of the lines that each document loses."""
    found = cut(windows(docs))
    counted = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "p0")).alias("first"))
    repeated = cut(counted.filter("n > 1"))
    places = join_by_count(found, repeated, ["a", "b"], "n", found.count())
    later = places.filter(~F.struct("d", "t", "p0").eqNullSafe(F.col("first")))
    spots = later.select("d", "t", F.explode(F.array("p0", "p1", "p2")).alias("p")).distinct()
    return spots.groupBy("d", "t").agg(F.sort_array(F.collect_list("p")).alias("gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without later occurrences; and _l_removed, the number of lines lost."""
    lost = covered(docs.select("doc_id", "text")).withColumnsRenamed({"d": "_l_d", "t": "_l_t", "gone": "_l_gone"})
    joined = docs.withColumn("_l_key", F.xxhash64("text")).join(
        lost, F.col("doc_id").eqNullSafe(F.col("_l_d")) & (F.col("_l_key") == F.col("_l_t")) & F.col("text").isNotNull(), "left"
    )
    lines = joined.withColumn("_l_all", F.when(F.col("_l_gone").isNotNull(), F.split("text", "\n")))
    begins = F.concat(F.array(F.lit(0)), F.transform("_l_gone", lambda p: p + 1))
    ends = F.concat(F.col("_l_gone"), F.array(F.size("_l_all")))
    spans = F.arrays_zip(begins.alias("b"), ends.alias("e"))
    kept = F.flatten(F.transform(spans, lambda s: F.slice("_l_all", s["b"] + 1, s["e"] - s["b"])))
    return (
        lines.withColumn("text", F.when(F.col("_l_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
        .withColumn("_l_removed", F.when(F.col("_l_gone").isNotNull(), F.size("_l_gone")).otherwise(0).cast("long"))
        .select(*docs.columns, "_l_removed")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with later occurrences of repeated three-line windows taken out of text."""
    return remove_repeats(docs).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "text", F.col("_l_removed").alias("n_removed"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
wins AS (
  SELECT doc_id, pos AS p0, lead(pos, 1) OVER o AS p1, lead(pos, 2) OVER o AS p2,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p0) AS n FROM wins WHERE p2 IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest([p0, p1, p2]) AS pos FROM later),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(l.n, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN lost l USING (doc_id)
"""

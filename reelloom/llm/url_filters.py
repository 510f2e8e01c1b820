"""Judging URLs by host and path rules: a sort-merge range join over reversed-host keys.

A host read backwards by labels, each label closed by a dot ("net.example.www."), turns "this
host and its subdomains" into the interval of keys that start with the rule's key. Such
intervals are nested or disjoint. Rules and distinct hosts are sorted together once, over range
partitions; the sweep keeps the last rule host seen at each number of labels, which is the stack
of nested rules, and a level is active for a key that starts with its rule's key. What a range
partition needs from those before it is one stack, carried over by a running maximum of few rows.

Defined results: a null url, or one without "://", has empty host and path, takes no rule and
gets the default verdict. Of rules that fit, the longest string wins, then the longer host; of
two rules with the same host and path, the block. Rules without a host are ignored; a null path
is the empty path. Repeated rows are judged alike. No column of the input but the id and the url
is read, so others may have any name. A url costs one comparison for each rule of its host and
the hosts above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, stack: for each distinct host under some rule host, the rules of all hosts above it."""
    ruled = (
        rules.filter(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(
            F.translate("host", UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "action",
        )
        .groupBy(reversed_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("level"))
        .agg(F.collect_set(F.struct("host", "path", "action")).alias("rules"))
    )
    levels = sorted(r.level for r in ruled.select("level").distinct().collect())  # at most 127 labels in a host
    nothing = ruled.schema["rules"].dataType
    events = ruled.select("key", F.lit(0).alias("kind"), "level", "rules", F.lit(None).cast("string").alias("host")).unionByName(
        hosts.select(
            reversed_key(F.col("host")).alias("key"),
            F.lit(1).alias("kind"),
            F.lit(None).cast("int").alias("level"),
            F.lit(None).cast(nothing).alias("rules"),
            "host",
        )
    )
    swept = cut(events.repartitionByRange("key", "kind").withColumn("slice", F.spark_partition_id()))
    opened = {n: F.when(F.col("level") == n, F.struct("key", "rules")) for n in levels}
    ends = swept.groupBy("slice").agg(
        *[F.max_by(F.struct("key", "rules"), F.when(F.col("level") == n, F.col("key"))).alias(f"end{n}") for n in levels],
        F.count("*").alias("n"),
    )
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    carried = ends.select("slice", *[F.last(f"end{n}", ignorenulls=True).over(earlier).alias(f"from{n}") for n in levels])
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stacked = (
        swept.select("slice", "key", "kind", "host", *[F.last(opened[n], ignorenulls=True).over(sweep).alias(f"top{n}") for n in levels])
        .filter("kind = 1")
        .join(carried, "slice")
    )
    tops = {n: F.coalesce(f"top{n}", f"from{n}") for n in levels}
    held = [F.when(F.col("key").startswith(tops[n]["key"]), tops[n]["rules"]) for n in levels]
    stack = F.flatten(F.array_compact(F.array(*held))) if held else F.lit(None).cast(nothing)
    return stacked.select("host", stack.alias("stack")).filter(F.size("stack") > 0)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of each row; rules has host, path and action ("allow" or "block")."""
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    stacks = active_rules(urls.select("host").distinct(), rules)
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(
        F.transform(
            fits,
            lambda r: F.struct(
                F.length(F.concat(r["host"], r["path"])).alias("size"),
                F.length(r["host"]).alias("host_size"),
                (r["action"] == "block").alias("blocks"),
                F.concat(r["host"], r["path"]).alias("rule"),
                r["action"].alias("action"),
            ),
        )
    )
    return (
        urls.join(stacks, "host", "left")
        .withColumn("best", best)
        .select(
            id_col,
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )


#: Fixed values of the query: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP1_SQL = """
WITH urls AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(host, path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE place = 1
"""

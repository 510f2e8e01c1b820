"""Exact top-k inner products: norm-sorted candidates, rotated partial sums, Cauchy-Schwarz pruning.

Components become whole numbers, so scores are exact. Spark sums the d x d second-moment matrix;
its singular vectors rotate all vectors so that the leading coordinates hold most of their length.
Candidates are cut into blocks by descending length, queries into blocks of their own; every
query meets every candidate block, one pair of bounded blocks a group. A group scores leading
coordinates first: what the rest can add is at most the product of the lengths of what is left.
A pair whose bound stays below the query's k-th best score so far is dropped, and a query is done
with a group when even the longest vector left cannot reach it. The starting bound comes from the
longest HEAD candidates, which all groups know: each query is scored against them first, and a band
of candidates whose longest cannot reach a query's k-th score there never meets it, nor is it sent to
a query block that no query of it needs. Whatever survives is scored in whole numbers;
bounds are widened by their rounding error, so nothing that belongs to the result is dropped.

Defined results: vectors that are null or hold a null or non-finite component take no part;
missing trailing components count as zero; rows with one vec_id are candidates each, and a query
skips all rows of its own id; ties go to the smaller vec_id. Vectors so long that a score could pass
64 bits are an error. A null vec_id takes no part; rows that repeat in full are candidates each.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCALE, K, HEAD, MOST_BANDS = 1024, 10, 1024, 256
CANDIDATE_BLOCK, QUERY_BLOCK, SLICE = 8192, 4096, 1024
#: The leading rotated coordinates are scored first, in this share of the dimensions.
LEAD = 0.25


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (whole numbers), norm of the vectors that take part."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    kept = kept.filter(F.forall("v", lambda x: x.isNotNull())).filter(
        F.forall("v", lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = kept.withColumn("norm", F.sqrt(squares)).withColumn("v", whole(F.col("v")))
    return kept.withColumn("long", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), "i8")
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal columns, the directions with most length first."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for pdf in batches:
            x = matrix(pdf["v"], dims).astype("f8")
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(dims * dims), "s": total.ravel()})

    cells = vectors.select("v").mapInPandas(partial, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()  # dims squared rows
    moments = np.zeros(dims * dims)
    for r in cells:
        moments[r.cell] = r.s
    return np.linalg.svd(moments.reshape(dims, dims))[0]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def first_bound(q_ids: np.ndarray, q: np.ndarray, head: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th best score of each query among the longest vectors of all: a bound from below, or minus infinity."""
    h_ids, h = head
    floor = np.full(len(q), -np.inf)
    if len(h) > k and len(q):
        s = q.astype("f8") @ h.T.astype("f8")
        s[q_ids[:, None] == h_ids[None, :]] = -np.inf
        floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return floor


def search_block(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, head: tuple[np.ndarray, np.ndarray]
) -> tuple[list, list, list]:
    """Query ids, candidate ids and scores of each query's k best in one block, or those that can be among its k best overall."""
    dims = q.shape[1]
    lead = max(1, math.ceil(dims * LEAD))
    order = np.argsort(-np.square(c.astype("f8")).sum(1), kind="stable")
    c, c_ids = c[order], c_ids[order]
    qr, cr = q.astype("f8") @ turn, c.astype("f8") @ turn
    q_long, c_long = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    floor = first_bound(q_ids, q, head, k)
    slack = 1e-9 * (q_long * (c_long.max() if len(c) else 0)) + 1e-6
    kept_s: list[np.ndarray] = [np.empty(0, "i8")] * len(q)
    kept_i: list[np.ndarray] = [np.empty(0, c_ids.dtype)] * len(q)
    for lo in range(0, len(c), SLICE):
        alive = np.flatnonzero(q_long * c_long[lo] + slack >= floor)
        if not len(alive):
            break
        part = slice(lo, lo + SLICE)
        bound = qr[alive][:, :lead] @ cr[part, :lead].T + q_rest[alive][:, None] * c_rest[part][None, :]
        maybe = bound + slack[alive][:, None] >= floor[alive][:, None]
        maybe &= q_ids[alive][:, None] != c_ids[part][None, :]
        for row in np.flatnonzero(maybe.any(1)):
            i = alive[row]
            found = np.flatnonzero(maybe[row])
            if len(found) > 4 * k:  # the rest of the coordinates, before whole numbers
                approx = cr[lo + found] @ qr[i]
                high = -np.partition(-approx, k - 1)[k - 1]
                found = found[approx + 2 * slack[i] >= max(high, floor[i])]
            scores = np.concatenate([kept_s[i], c[lo + found] @ q[i]])
            names = np.concatenate([kept_i[i], c_ids[lo + found]])
            top = best(scores, names, k)
            kept_s[i], kept_i[i] = scores[top], names[top]
            if len(top) == k:
                floor[i] = max(floor[i], float(kept_s[i][-1]))
    queries = np.repeat(np.arange(len(q)), [len(x) for x in kept_s])
    return [q_ids[queries], np.concatenate(kept_i) if len(q) else [], np.concatenate(kept_s) if len(q) else []]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best among the rows of vectors with another id."""
    spark = vectors.sparkSession
    base = cut(usable(vectors, id_col, vector_col))
    asked = cut(usable(queries, id_col, vector_col).select("id", "v", "long"))
    size = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max("long").alias("long")).first()
    n_asked = asked.count()
    out = "query_id long, vec_id long, score long"
    if not size.n or not n_asked:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    reached = asked.agg(F.max(F.size("v")).alias("d"), F.max("long").alias("long")).first()
    if size.long * reached.long >= 2.0**62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    dims = max(1, size.d, reached.d)
    turn = rotation(base, dims)
    top = base.orderBy(F.desc("norm"), "id").limit(HEAD).toPandas()  # HEAD rows
    head = (top["id"].to_numpy("i8"), matrix(top["v"], dims))
    shared = spark.sparkContext.broadcast((turn, head))  # dims * (dims + HEAD) numbers

    # Blocks by length: bands cut at quantiles of the norm, and within one band parts by a hash of the id,
    # as many as its count asks for, so that equal lengths fill no block beyond its size.
    n_bands = min(MOST_BANDS, -(-size.n // CANDIDATE_BLOCK))
    edges = base.approxQuantile("norm", [i / n_bands for i in range(1, n_bands)], 0.1 / n_bands) if n_bands > 1 else []
    band = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e > F.col("norm"))) if edges else F.lit(0)
    banded = base.select("id", "v", "long", band.alias("band"))
    parts = cut(banded.groupBy("band").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).cast("int").alias("parts"), F.max("long").alias("longest")))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(floor=first_bound(pdf["id"].to_numpy("i8"), matrix(pdf["v"], dims), shared.value[1], k))
    q_blocks = -(-n_asked // QUERY_BLOCK)
    known = asked.mapInPandas(bounded, "id long, v array<bigint>, long double, floor double").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
    reach = F.col("long") * F.col("longest") * (1 + 1e-9) + 1e-6
    needed = cut(known.join(F.broadcast(parts), reach >= F.col("floor")).select("id", "v", "qb", "band", "parts"))  # MOST_BANDS rows at most
    askers = needed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "v", "band", "part", "qb")
    blocked = banded.join(F.broadcast(parts), "band").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    candidates = blocked.join(needed.select("band", "qb").distinct(), "band").select("id", "v", "band", "part", "qb")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        turn, head = shared.value
        rows = search_block(right["id"].to_numpy("i8"), matrix(right["v"], dims), left["id"].to_numpy("i8"), matrix(left["v"], dims), turn, k, head)
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], rows, strict=True)))

    keys = ["band", "part", "qb"]
    found = candidates.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(meet, out)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH fine AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(1024 * unnest(embedding)::DOUBLE) AS BIGINT) AS x FROM fine),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores) WHERE place <= 10
"""

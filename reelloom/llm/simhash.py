"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at 3 or fewer differing bits. Two fingerprints at distance d meet in
a word between them, so if one emits all words within 1 bit of it and the other all within 2,
they share an emitted word for every d up to 3. Distances of 1 and 3 change the parity of the
number of bits, a distance of 2 does not, so fingerprints of even parity emit 65 words and only
those of odd parity 2,081. Whoever stands within 1 bit of a shared word may be linked to all that
emitted it: 1 + 2 is 3, so a collision is itself the proof, and each word gives a star of links to
its least such fingerprint in place of all pairs. Two of odd parity that both stand 2 bits off
are not linked by that word. A word is emitted by at most 2,081 different fingerprints.

Only different fingerprints take part, and of those only such as may have a partner: with 64 bits
cut into n blocks, 3 differing bits leave n - 3 blocks equal, so a fingerprint that shares no choice
of that many blocks with another emits nothing. This test loses no link; n follows from the number
of fingerprints, so that few pass it by chance. The verdict of links is then checked by counting bits, and components are found by star steps.

Defined results: A-Z are lower-cased, words are joined by one space in shingles; a text with
fewer words than a shingle is one shingle; a null or blank text has fingerprint zero, which
links like any other. Documents with a null doc_id belong to components but do not name them.
Repeated rows each get a row. Other columns are not read by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_by_count, table
from .components import components

BITS, RADIUS, SEED = 64, 3, 42
SHINGLE = 3
#: Words that one task emits, about.
BALL_ROWS = 1_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, "u1") == 32)
        starts = [0, *(spaces[: len(found) - shingle] + 1).tolist()]
        ends = [*spaces[shingle - 1 :].tolist(), len(joined)]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    n, ones = len(hashes), np.zeros(BITS, "i8")
    values = np.array(hashes, "<u8")
    for lo in range(0, n, 8192):  # bounded, whatever the text's length
        ones += np.unpackbits(values[lo : lo + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (a hash of the text, 0 for null) and fp of every row."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], "i8")
            yield pdf.drop(columns="text").assign(fp=fp)

    source = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("missing"),
        text_key().alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = source.mapInPandas(task, "doc_id long, missing boolean, key long, fp long")
    return found.select(F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "key", "fp")


def text_key() -> Column:
    return F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def _masks(radius: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for k in range(radius + 1) for c in combinations(range(BITS), k)]


def _block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key for each choice of blocks that may be equal: its number, and the bits of those blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.struct(F.lit(k).cast("short").alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(chosen)])


def fit_blocks(n: int, radius: int = RADIUS) -> int:
    """Blocks so many that of n random fingerprints no more than about a hundredth share a choice by chance."""
    for blocks in range(8, BITS // 2):
        if comb(blocks, radius) * n <= 0.01 * 2 ** (BITS * (blocks - radius) // blocks):
            return blocks
    return BITS // 2


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """a, b: links whose closure joins all fingerprints in distinct (fp) at up to radius bits; blocks follow from their number."""
    near, far = radius // 2, radius - radius // 2
    distinct = cut(distinct)
    count = distinct.count()
    blocks = blocks or fit_blocks(count, radius)
    keyed = distinct.select("fp", F.explode(_block_keys(F.col("fp"), blocks, radius)).alias("key")).select("fp", "key.choice", "key.bits")
    shared = cut(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1"))
    able = cut(join_by_count(keyed, shared, ["choice", "bits"], "n", count * comb(blocks, radius), "merge").select("fp").distinct())
    wide = F.bit_count("fp") % 2 == 1 if radius % 2 else F.lit(True)
    n_near = len(_masks(near))
    words = F.transform(
        F.when(wide, F.array(*[F.lit(m) for m in _masks(far)])).otherwise(F.array(*[F.lit(m) for m in _masks(near)])), lambda m: m.bitwiseXOR(F.col("fp"))
    )
    # Balls are many words to a fingerprint: dealt out by their number first, however few tasks hold the fingerprints.
    spread = -(-able.count() * len(_masks(far)) // BALL_ROWS)
    able = able.repartition(max(1, spread, int(able.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "fp")
    emitted = able.select("fp", F.posexplode(words).alias("place", "word"))
    group = Window.partitionBy("word")  # at most as many rows as a ball has words
    centre = F.min(F.when(F.col("place") < n_near, F.col("fp"))).over(group)
    met = emitted.withColumn("centre", centre).filter("centre <> fp")
    pairs = met.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable) of every row."""
    marked = cut(fingerprints(docs, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    graph = components(links(classes.select("fp"), radius, blocks))
    grouped = cut(classes.join(graph, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp")))
    tops = cut(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    named = cut(join_by_count(grouped.select("fp", "root", "n"), tops, ["root"], "members", grouped.count()).select("fp", "n", "component_id"))
    return join_by_count(marked, named, ["fp"], "n", marked.count()).select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """The rows of docs, one of each component: the least doc_id, then the least text hash; all columns kept.

    Rows with that doc_id and text that are alike in full stay once. A component without any
    doc_id keeps the row of the least text hash. Only ids and hashes are shuffled to choose, and each
    fingerprint is one row before it meets its component, so copies make no hot key.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = cut(fingerprints(docs, shingle).groupBy("fp").agg(F.min(row).alias("least")))
    return one_a_component(docs, classes, components(links(classes.select("fp"), radius, blocks)))


def one_a_component(docs: DataFrame, classes: DataFrame, graph: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their component; classes has fp and least, graph node and component."""
    rooted = classes.join(graph, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("least").alias("least"))
    stays = chosen.select(F.col("least.doc_id").alias("_s_doc"), F.col("least.key").alias("_s_key"))
    own = docs.withColumn("_s_own", text_key())
    kept = own.join(stays, F.col("doc_id").eqNullSafe(F.col("_s_doc")) & (F.col("_s_own") == F.col("_s_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_s_own"]).drop("_s_own")

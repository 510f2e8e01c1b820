"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A rolling hash over seven bytes decides from the text alone where a chunk ends; each chunk gives one
letter. A fingerprint is "size:letters:letters", at the block size fit for the text's length and at
twice that size, so texts whose sizes differ by a factor of two still share one. The block size is
3 * 2^k, the least that gives about 64 chunks by length; texts that trigger too often (more than 128
chunks) take the next larger sizes, those that hardly do (under 16) the next smaller. Likeness is
2 * common / (m + n) of two signatures at a shared block size, where m + n - 2 * common is their edit
distance by insertions and deletions; signatures without a common run of four letters have none.

The query needs each document beside the one that follows it. Rows are dealt to blocks of ids at
bounds drawn from a sample of the rows, each text compressed; the row at a block's lower bound also
goes to the block before it, so every block holds its own successors and is read once, in order,
with two texts in memory at a time. Nothing depends on how many rows the sample holds but the
evenness of the blocks.

Defined results: a null text is an empty one, whose fingerprint is "3::"; two equal fingerprints have
likeness 1. Null doc_ids come first; rows of one doc_id are ordered by a hash of their text, and a
repeated row follows its copy. A table of one row is its own next. An empty table has no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes of the rolling window, least block size, chunks aimed at, most and fewest of them.
WINDOW, LEAST, AIM, MOST, FEWEST = 7, 3, 64, 128, 16
#: Letters that two signatures must share in a row; shorter signatures are like none, as they agree by chance.
RUN = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes hashed at once.
STEP = 1 << 20


def _rolled(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum, the weighted sum and the shifted bits of the last seven bytes, modulo 2^32."""
    n = len(data)
    if not n:
        return np.empty(0, "u4")
    padded = np.zeros(n + WINDOW + 1, "u4")
    padded[WINDOW + 1 :] = data
    sums = np.cumsum(padded, dtype="u4")
    twice = np.cumsum(sums, dtype="u4")
    plain = sums[WINDOW + 1 :] - sums[1:-WINDOW]
    weighted = np.uint32(WINDOW) * sums[WINDOW + 1 :] - (twice[WINDOW:-1] - twice[: -WINDOW - 1])  # the last byte counts 7, the first of the window 1
    one = padded
    two = one[1:] ^ (one[:-1] << np.uint32(5))
    four = two[2:] ^ (two[:-2] << np.uint32(10))
    shifted = four[-n:] ^ (two[-n - 4 : -4] << np.uint32(20)) ^ (one[-n - 6 : -6] << np.uint32(30))
    return plain + weighted + shifted


#: A 32-bit number times this is its third, if that is whole, and more than MOST_THIRD if it is not.
THIRD, MOST_THIRD = np.uint32(0xAAAAAAAB), np.uint32(0x55555555)


def _triggers(octets: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks at the least size, where the hash is size - 1 modulo the size, and for each the largest k whose size 3 * 2^k keeps it."""
    data = np.frombuffer(octets, "u1")
    ends, ranks = [np.empty(0, "i8")], [np.empty(0, "i8")]
    for lo in range(0, len(data), STEP):  # bounded, whatever the text's length
        start = max(0, lo - WINDOW + 1)
        third = (_rolled(data[start : lo + STEP])[lo - start :] + np.uint32(1)) * THIRD
        at = np.flatnonzero(third <= MOST_THIRD)
        left = third[at].astype("i8")
        at, left = at[left > 0], left[left > 0]
        ends.append(at + lo + 1)
        ranks.append(np.frexp((left & -left).astype("f8"))[1] - 1)  # twos in the quotient
    return np.concatenate(ends), np.concatenate(ranks)


def _signature(octets: bytes, ends: np.ndarray) -> str:
    """One letter for each chunk; what follows the last end is a chunk if it is not empty."""
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(octets):
        cuts.append(len(octets))
    view = memoryview(octets)
    return "".join([LETTERS[zlib.crc32(view[a:b]) >> 26] for a, b in zip(cuts, cuts[1:], strict=False)])


def fingerprint(text: str) -> str:
    octets = text.encode()
    ends, ranks = _triggers(octets)
    k = 0
    while (LEAST << k) * AIM < len(octets):
        k += 1
    chunks = lambda j: int((ranks >= j).sum()) + 1
    while chunks(k) > MOST:
        k += 1
    while k > 0 and chunks(k) < FEWEST and chunks(k - 1) <= MOST:
        k -= 1
    return f"{LEAST << k}:{_signature(octets, ends[ranks >= k])}:{_signature(octets, ends[ranks > k])}"


def _common(a: str, b: str) -> int:
    """Letters of the longest common subsequence: one bit for each letter of a, one step for each of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        met = rest & places.get(c, 0)
        rest = (rest + met | rest - met) & full
    return len(a) - rest.bit_count()


def _alike(a: str, b: str) -> float:
    if {a[i : i + RUN] for i in range(len(a) - RUN + 1)}.isdisjoint(b[i : i + RUN] for i in range(len(b) - RUN + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: the better of the block sizes that both fingerprints have; 0 if they share none."""
    if one == other:
        return 1.0
    a, b = ((int(size), {int(size): first, 2 * int(size): second}) for size, first, second in (one.split(":"), other.split(":")))
    return max([_alike(a[1][s], b[1][s]) for s in a[1].keys() & b[1].keys()], default=0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, where it stands."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "missing", "n_chars"]].assign(fingerprint=[fingerprint(t) for t in pdf["text"]])

    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("missing"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.coalesce("text", F.lit("")).alias("text")
    )
    found = rows.mapInPandas(task, "doc_id long, missing boolean, n_chars long, fingerprint string")
    return found.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


#: Rows sampled for each bound between blocks.
SAMPLES = 20

EDITED = "doc_id long, missing boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bounds(docs: DataFrame, blocks: int) -> list[tuple]:
    """The lower bounds of about so many blocks of rows (there, doc_id, key): the least row, then sampled ones."""
    least = docs.agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if not least.n:
        return []
    place = _place(docs)
    first = place.filter(~F.col("there") if least.nulls else F.col("doc_id") == least.id).agg(F.min("key")).first()[0]
    drawn = place.sample(min(1.0, blocks * SAMPLES / least.n), seed=7).sort("there", "doc_id", "key").limit(4 * blocks * SAMPLES).collect()
    step = max(1, len(drawn) // blocks)
    return sorted({(not least.nulls, 0 if least.nulls else least.id, first), *map(tuple, drawn[step::step])})


def _place(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))


def successors(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """EDITED: each row beside the next one in order of doc_id; after the last comes the first."""
    import zstandard

    lower = bounds(docs, blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's block; a row at a lower bound trails the block before, the first row the last block."""
        press = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            packed = [press.compress(t.encode()) for t in pdf["text"]]
            own = pdf[["there", "doc_id", "key"]].assign(fingerprint=[fingerprint(t) for t in pdf["text"]], packed=packed)
            places = list(zip(pdf["there"].tolist(), pdf["doc_id"].tolist(), pdf["key"].tolist(), strict=True))
            held = [bisect_right(lower, p) - 1 for p in places]
            yield own.assign(block=held, trails=False)
            edge = [i for i, p in enumerate(places) if p == lower[held[i]]]
            if edge:
                yield own.iloc[edge].assign(block=[(held[i] - 1) % len(lower) for i in edge], trails=True)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of block; the last row is held until the next comes by."""
        unpack = zstandard.ZstdDecompressor()
        last = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                now = (r.block, r.trails, r.there, r.doc_id, unpack.decompress(r.packed).decode(), r.fingerprint)
                if last is not None and last[0] == now[0] and not last[1]:
                    out.append(_compared(*last[2:], now[4], now[5]))
                last = now
            if out:
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in EDITED.split(", ")])

    dealt = rows.mapInPandas(deal, "there boolean, doc_id long, key long, fingerprint string, packed binary, block int, trails boolean")
    order = ["block", "trails", "there", "doc_id", "key"]
    found = dealt.repartitionById(max(1, len(lower)), "block").sortWithinPartitions(*order).mapInPandas(walk, EDITED)
    return found.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(there: bool, doc_id: int, text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following)
    changed_print = own if changed == text else fingerprint(changed)
    return (doc_id, not there, len(text), sha256(changed.encode()).hexdigest(), own, changed_print, likeness(own, changed_print), likeness(own, its))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successors(table(spark, sf_dir, "documents"))

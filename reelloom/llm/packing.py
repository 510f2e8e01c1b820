"""Packing documents into sequences of a fixed length: cutting stock by column generation.

One pass tokenizes the texts and turns each document into pieces: as many full sequences as it
fills, and a rest. Rests under BUNDLE tokens are joined end to end, within a task, into bundles
of exactly BUNDLE tokens. Rests and bundles are the items; their lengths, in units of GRID
tokens rounded up, form a histogram of at most capacity / GRID counts. Only that histogram goes to
the driver. There a linear program over patterns (how many items of each length a sequence takes)
is solved by column generation: a knapsack by dynamic programming prices the columns, the simplex
method takes the best one in. Patterns are used as often as their rounded-down amounts say;
the few items left over are placed first-fit, longest first. Items are ranked within their length
(a rank in the task that made them plus the counts of the tasks before it), so each finds its
pattern, its sequence and its place there from its rank alone. No text is shuffled.

Defined results: a null text is empty and holds the end id alone; an empty table has no pieces;
repeated rows are packed each time; a null doc_id is kept. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .token_files import cache

LENGTH, GRID, BUNDLE = 2048, 16, 256

PIECE = "struct<doc_id:bigint,missing:boolean,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,within:bigint>"


def items(docs: DataFrame, tokenizer: str, end_id: int, kind: str, length: int, grid: int, bundle: int) -> DataFrame:
    """part, unit, local, size, pieces: what is to be packed; unit 0 marks full sequences."""

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, rows = None, 0, []
        seen: dict[int, int] = {}
        open_pieces, open_size = [], 0

        def item(size: int, pieces: list[dict]) -> None:
            unit = 0 if size == length else -(-size // grid)
            rows.append((part, unit, seen.get(unit, 0), size, pieces))
            seen[unit] = seen.get(unit, 0) + 1

        def flush() -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=["part", "unit", "local", "size", "pieces"])
            rows.clear()
            return made

        for pdf in batches:
            words = words or cache(tokenizer, kind)
            part = int(pdf["part"].iloc[0])
            for doc, missing, text in zip(pdf["doc_id"], pdf["missing"], pdf["text"], strict=True):
                ids = np.append(np.frombuffer(words.ids(text), words.type), np.array([end_id], words.type))
                n = len(ids)

                def piece(a: int, b: int, within: int, doc=doc, missing=missing, ids=ids, n=n) -> dict:
                    return {"doc_id": int(doc), "missing": bool(missing), "start": a, "length": b - a, "ids_crc32": crc(ids[a:b]), "doc_tokens": n, "within": within}

                at = 0
                while n - at >= length:
                    item(length, [piece(at, at + length, 0)])
                    at += length
                if n - at >= bundle:
                    item(n - at, [piece(at, n, 0)])
                    at = n
                while at < n:
                    to = min(n, at + bundle - open_size)
                    open_pieces.append(piece(at, to, open_size))
                    open_size += to - at
                    at = to
                    if open_size == bundle:
                        item(bundle, open_pieces)
                        open_pieces, open_size = [], 0
                if len(rows) >= 5000:
                    yield flush()
        if open_size:
            item(open_size, open_pieces)
        if rows:
            yield flush()

    texts = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("missing"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.spark_partition_id().alias("part"),
    )
    return texts.mapInPandas(task, f"part int, unit int, local long, size long, pieces array<{PIECE}>")


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over lengths 1..capacity: the most valuable pattern and its counts."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        gains = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(np.argmax(gains))
        best[c], last[c] = (gains[k], k + 1) if gains[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    counts, c = np.zeros(capacity + 1, int), capacity
    while c > 0:
        if last[c]:
            counts[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def patterns(demand: np.ndarray, rounds: int = 100_000) -> list[tuple[np.ndarray, int]]:
    """(counts by length, how often) that cover demand[1..capacity] exactly; counts are indexed by length.

    Columns are priced until none improves the linear program; not to get there in so many rounds is an error.
    """
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    need = demand[lengths].astype(float)
    basis = np.diag((capacity // lengths).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(lengths)))
        values = np.full(capacity + 1, -1.0)
        values[lengths] = price
        value, counts = best_pattern(values, capacity)
        if value <= 1 + 1e-9:
            break
        column = counts[lengths].astype(float)
        amount, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    else:
        raise RuntimeError(f"the linear program is not solved after {rounds} rounds")
    amount = np.maximum(np.linalg.solve(basis, need), 0)
    left = demand.astype(int).copy()
    plan = []
    for k, x in enumerate(np.floor(amount + 1e-7).astype(int)):
        counts = np.zeros(capacity + 1, int)
        counts[lengths] = np.rint(basis[:, k]).astype(int)
        fits = int(min((left[i] // counts[i] for i in np.flatnonzero(counts)), default=0))
        x = min(x, fits)
        if x > 0:
            plan.append((counts, int(x)))
            left -= counts * x
    bins: list[tuple[int, np.ndarray]] = []
    for size in range(capacity, 0, -1):
        for _ in range(int(left[size])):
            for k, (room, counts) in enumerate(bins):
                if room >= size:
                    counts[size] += 1
                    bins[k] = (room - size, counts)
                    break
            else:
                counts = np.zeros(capacity + 1, int)
                counts[size] = 1
                bins.append((capacity - size, counts))
    return plan + [(counts, 1) for _, counts in bins]


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, kind: str = "end", length: int = LENGTH, grid: int = GRID, bundle: int = BUNDLE
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    made = cut(items(docs, tokenizer, end_id, kind, length, grid, bundle))
    counts = cut(made.groupBy("unit", "part").agg(F.count("*").alias("n")))
    demand = np.zeros(length // grid + 1, "i8")
    for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect():  # one row a length, length / grid + 1 at most
        demand[r.unit] = r.n
    full, demand[0] = int(demand[0]), 0
    slots, sequences, ranked = [], 0, {}
    for pattern, times in patterns(demand):
        for unit in np.flatnonzero(pattern):
            first = ranked.get(int(unit), 0)
            slots.append((int(unit), first, first + int(pattern[unit]) * times, int(pattern[unit]), sequences))
            ranked[int(unit)] = first + int(pattern[unit]) * times
        sequences += times
    slots.append((0, 0, full, 1, sequences))
    plan = spark.createDataFrame(slots, "slot_unit int, first long, beyond long, each long, sequence long")  # at most the number of lengths squared
    earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("unit", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("from"))
    rank = F.col("from") + F.col("local")
    placed = (
        made.join(starts, ["unit", "part"])
        .withColumn("rank", rank)
        .join(F.broadcast(plan), (F.col("unit") == F.col("slot_unit")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
        .withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div each"))
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("unit"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    seated = placed.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return seated.select("sequence_id", "at", F.explode("pieces").alias("p")).select(
        F.when(~F.col("p.missing"), F.col("p.doc_id")).alias("doc_id"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.col("p.ids_crc32").alias("ids_crc32"),
        F.col("p.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + F.col("p.within")).alias("offset"),
    )


#: Fixed values of the query.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer(), END_ID)

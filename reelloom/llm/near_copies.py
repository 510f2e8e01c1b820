"""Near copies for the pipeline: five-word shingles, a Jaccard similarity of 0.8 or more.

Texts with the same set of shingles are one class. Each class has BANDS * ROWS minhashes; classes
that agree on all ROWS of a band share a bucket, which two of similarity 0.8 do in some band with
odds of 0.9996. All buckets stand in one range-partitioned sort, ordered inside by the minhashes
that follow the band's, so that the more similar stand closer. A class meets the rows after it in
its bucket, across the ends of partitions too, in passes: first the next one, then the others up to
NEXT. After each pass links are closed to components, and later passes leave out pairs within one,
since a link between such would follow from links at hand. A bucket of NEXT + 1 classes or fewer is
paired in full; in a larger one two classes may stand farther apart in all bands that they share.
With whole set, buckets of more classes that still hold several components go on alone, with windows
16 times as wide each time, until every two of their classes have met or are in one component: no
link is lost then, but the pairs of a bucket of many unlike classes grow with its square, so this is
for corpora without large groups of texts that are near to each other and yet under 0.8.
Pairs that agree on fewer than LEAST_EQUAL minhashes go (odds below 1e-5 at 0.8), and each other
pair is settled by its exact sets of shingles. Links are closed to components.

Defined results: as in `simhash`, A-Z are lower-cased, a text with fewer words than a shingle is
one shingle, and all null or blank texts are one class. Repeated rows stay once, an empty table
gives an empty result, and all columns of docs are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut
from .components import components
from .simhash import one_a_component, text_key

SHINGLE, SEED = 5, 42
BANDS, ROWS, FIRST, NEXT, LEAST_EQUAL = 20, 5, 1, 16, 60
#: How many times wider each further window is.
WIDER = 16
#: Similarity of 0.8 as a fraction.
PART, WHOLE = 4, 5
HASHES = BANDS * ROWS
ODD = np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype="u8") * np.uint64(2) + np.uint64(1)
TAIL = 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.array([xxh64_intdigest(w, SEED) for w in found], "u8")
    width = max(1, min(SHINGLE, len(h)))
    n = max(0, len(h) - width + 1)
    joined = np.full(n, width, "u8")
    for i in range(width):
        joined = _mix(joined * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(joined)


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, (1 << 64) - 1, "u8")
    for lo in range(0, len(found), 2048):  # bounded, whatever the text's length
        least = np.minimum(least, _mix(found[lo : lo + 2048, None] * ODD).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def _class_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view("i8")) if len(found) else 0


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp (the class), size and mins of every row."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(fp=[_class_of(s) for s in found], size=[len(s) for s in found], mins=[minhashes(s).tobytes() for s in found])

    source = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("missing"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )
    found = source.mapInPandas(task, "doc_id long, missing boolean, key long, fp long, size long, mins binary")
    return found.select(F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "key", "fp", "size", "mins")


def places(mins: np.ndarray, band: int) -> np.ndarray:
    """Of each row of mins: 8 bytes that name its bucket in a band, then 16 that order it inside."""
    bucket = np.full(len(mins), band, "u8")
    for i in range(ROWS):
        bucket = _mix(bucket * np.uint64(0x9E3779B97F4A7C15) + mins[:, band * ROWS + i])
    after = mins[:, [(band * ROWS + ROWS + i) % HASHES for i in range(TAIL)]] >> np.uint32(16)
    return np.concatenate([bucket.astype(">u8").view("u1").reshape(-1, 8), np.ascontiguousarray(after, ">u2").view("u1").reshape(-1, 2 * TAIL)], axis=1)


def _placed(classes: DataFrame) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mins = np.frombuffer(b"".join(pdf["mins"]), "<u4").reshape(-1, HASHES)
            for band in range(BANDS):
                yield pd.DataFrame({"place": [x.tobytes() for x in places(mins, band)], "fp": pdf["fp"], "label": pdf["label"]})

    label = "label" if "label" in classes.columns else "fp"
    return classes.filter("size > 0").select("fp", F.col(label).alias("label"), "mins").mapInPandas(task, "place binary, fp long, label long")


def _met(bucket: np.ndarray, fp: np.ndarray, label: np.ndarray, n_old: int, inside: int, after: int, ahead: int) -> pd.DataFrame:
    """Pairs of a row before inside with a row from n_old on, more than after and up to ahead rows on; and a row without b for a bucket that goes on beyond."""
    a, b = [], []
    for s in range(after + 1, ahead + 1):
        i = np.arange(max(0, n_old - s), min(len(fp) - s, inside))
        i = i[(bucket[i] == bucket[i + s]) & (label[i] != label[i + s])]
        a.append(np.minimum(fp[i], fp[i + s]))
        b.append(np.maximum(fp[i], fp[i + s]))
    i = np.arange(max(0, n_old - ahead - 1), min(len(fp) - ahead - 1, inside))
    beyond = np.unique(bucket[i[bucket[i] == bucket[i + ahead + 1]]]).view("i8")
    pairs = pd.DataFrame({"a": np.concatenate(a), "b": pd.array(np.concatenate(b), "Int64")})
    return pd.concat([pairs, pd.DataFrame({"a": beyond, "b": pd.array([None] * len(beyond), "Int64")})]) if len(beyond) else pairs


def _windows(batches: Iterator[pd.DataFrame], heads: list[tuple[int, int, int]], after: int, ahead: int) -> Iterator[pd.DataFrame]:
    """_met of rows (place, fp, label) in order; heads are the rows that follow the last one: bucket, fp, label."""
    bucket, fp, label = np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    for pdf in batches:
        old = len(fp)
        bucket = np.concatenate([bucket, np.array([int.from_bytes(x[:8], "big") for x in pdf["place"]], "u8")])
        fp, label = np.concatenate([fp, pdf["fp"].to_numpy("i8")]), np.concatenate([label, pdf["label"].to_numpy("i8")])
        yield _met(bucket, fp, label, old, len(fp), after, ahead)
        bucket, fp, label = bucket[-ahead - 1 :], fp[-ahead - 1 :], label[-ahead - 1 :]
    old = len(fp)
    bucket = np.concatenate([bucket, np.array([k for k, _, _ in heads], "u8")])
    fp, label = np.concatenate([fp, np.array([f for _, f, _ in heads], "i8")]), np.concatenate([label, np.array([x for _, _, x in heads], "i8")])
    yield _met(bucket, fp, label, old, old, after, ahead)


def met(classes: DataFrame, after: int = 0, ahead: int = NEXT) -> DataFrame:
    """a, b (a < b): different classes that stand more than after and up to ahead places from each other in a bucket; kept.

    Classes may have a label; those that share one are not paired. A row without b names in a a
    bucket whose rows reach beyond.
    """
    ordered = cut(_placed(classes).repartitionByRange("place", "fp").sortWithinPartitions("place", "fp"))
    numbered = ordered.withColumn("n", F.monotonically_increasing_id())
    first = numbered.filter(F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) <= ahead).collect()
    first.sort(key=lambda r: r.n)
    heads = ordered.sparkSession.sparkContext.broadcast([(r.n >> 33, bytes(r.place[:8]), r.fp, r.label) for r in first])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        beyond = [(int.from_bytes(k, "big"), f, x) for p, k, f, x in heads.value if p > part][: ahead + 1]
        yield from _windows(batches, beyond, after, ahead)

    return cut(ordered.mapInPandas(task, "a long, b long").distinct())


def candidates(classes: DataFrame, after: int = 0, ahead: int = NEXT) -> DataFrame:
    return met(classes, after, ahead).filter("b IS NOT NULL")


def _bucket(place: str = "place") -> Column:
    """The name of a bucket as `met` gives it: the first eight bytes of a place as a signed number."""
    return F.conv(F.hex(F.substring(place, 1, 8)), 16, -10).cast("long")


def settled(docs: DataFrame, classes: DataFrame, first: int = FIRST, following: int = NEXT, whole: bool = False) -> DataFrame:
    """node, component: the component of each class (fp, least, size, mins; kept)."""

    def joined(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
        """The labels after more candidates: only the components that new links touch are closed again."""
        fresh = cut(links(docs, labelled, pairs))
        if fresh.isEmpty():
            return labelled
        between = _sides(fresh, labelled, "label").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
        moved = cut(components(between)).select(F.col("node").alias("label"), "component")
        return cut(labelled.join(moved, "label", "left").withColumn("label", F.coalesce("component", "label")).select(*labelled.columns))

    labelled = classes.withColumn("label", F.col("fp"))
    labelled = joined(labelled, candidates(labelled, 0, first))
    found = met(labelled, first, following)
    labelled = joined(labelled, found.filter("b IS NOT NULL"))
    crowded = found.filter("b IS NULL").select(F.col("a").alias("bucket")).distinct()
    if whole and not (crowded := cut(crowded)).isEmpty():
        rows = cut(_placed(classes).withColumn("bucket", _bucket()).join(broadcast_if_small(crowded), "bucket", "left_semi").select("bucket", "place", "fp"))
        after, ahead = following, WIDER * following
        while True:
            named = rows.join(labelled.select("fp", "label"), "fp")
            mixed = cut(named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter((F.col("n") > after + 1) & (F.col("low") != F.col("high"))))
            if mixed.isEmpty():
                break
            left = named.join(broadcast_if_small(mixed.select("bucket")), "bucket", "left_semi")
            ordered = left.repartition("bucket").sortWithinPartitions("place", "fp").select("place", "fp", "label")
            pairs = ordered.mapInPandas(lambda batches, a=after, b=ahead: _windows(batches, [], a, b), "a long, b long")
            labelled = joined(labelled, cut(pairs.filter("b IS NOT NULL").distinct()))
            after, ahead = ahead, WIDER * ahead
    return labelled.select(F.col("fp").alias("node"), F.col("label").alias("component"))


def _sides(pairs: DataFrame, kept: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        named = kept.select(F.col("fp").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(named, side)
    return pairs


def links(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: classes of the candidates found whose sets of shingles are similar; classes has fp, least, size and mins."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[c]), "<u4").reshape(-1, HASHES) for c in ("mins_a", "mins_b"))
            yield pdf.loc[(a == b).sum(1) >= LEAST_EQUAL, ["a", "b"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"fp": [_class_of(s) for s in own], "found": [s.tobytes() for s in own]})

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [(np.frombuffer(x, "u8"), np.frombuffer(y, "u8")) for x, y in zip(pdf["found_a"], pdf["found_b"], strict=True)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
            good = [(PART + WHOLE) * n >= PART * (len(x) + len(y)) for n, (x, y) in zip(common, both, strict=True)]
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    sized = _sides(found, classes, "size", "mins").filter(WHOLE * F.least("size_a", "size_b") >= PART * F.greatest("size_a", "size_b"))
    pairs = cut(sized.select("a", "b", "mins_a", "mins_b").mapInPandas(alike, "a long, b long"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = classes.join(ends, "fp", "left_semi").select(F.col("least.doc_id").alias("_n_doc"), F.col("least.key").alias("_n_key"))
    wanted = broadcast_if_small(cut(wanted))
    own = docs.select(F.col("doc_id").alias("_n_id"), "text", text_key().alias("_n_own"))
    texts = own.join(wanted, F.col("_n_id").eqNullSafe(F.col("_n_doc")) & (F.col("_n_own") == F.col("_n_key")), "left_semi")
    texts = texts.dropDuplicates(["_n_id", "_n_own"]).select(F.coalesce("text", F.lit("")).alias("text"))
    whole = cut(texts.mapInPandas(sets, "fp long, found binary"))
    return _sides(pairs, whole, "found").mapInPandas(similar, "a long, b long")


def keep_one(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of docs, one of each component of near copies: the one that `simhash.keep_one` would choose."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = cut(_marked(docs).groupBy("fp").agg(F.min(row).alias("least"), F.min("size").alias("size"), F.min("mins").alias("mins")))
    return one_a_component(docs, classes, settled(docs, classes, whole=whole))

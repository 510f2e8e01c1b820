"""Spelling variants: frequent words that one inserted, deleted or replaced letter sets apart, found by variable-length grams.

Words are counted first, one row a task and word, so that a common word is no hot key. All else
works on the distinct words.

1. The gram dictionary holds every gram of two letters, and a longer one (up to four) only if all its
   shorter beginnings stand at more than FREQUENT places of the words: long grams exist where short
   ones would have long lists. It is given by the frequent grams of two and three letters, at most
   90^2 + 90^3 in the alphabet of words, so it may be sent to every task.
2. A word has, from each letter on, the longest gram of the dictionary. Grams that lie in longer ones
   stay: each then depends on its own letters alone (or on the word's end), and one edit changes no
   more than the grams that cover a letter, or those that the word's end cut short. The largest
   number that one edit can change is the word's bound, at most four, so words of six letters share
   a gram at least with each word near them.
3. Under one order of all grams, rare ones first, the first common gram of two near words is among the
   first bound + 1 of both. Only these lists are merged. A gram that an edit spares lies wholly left
   or right of it, so its list is cut by the letters on its other side: words meet if they agree
   from their start to the gram's end, or from its start to their end.
4. A list of more than LONGEST words is not paired: its words meet again by what is left of them with
   one letter taken out, which near words share.
5. Pairs that meet are verified letter by letter.

Defined results: a null text has no words; a null doc_id counts as empty text before the colon of the
digest. Repeated rows count each time. Ties of n go to the smaller word by code points. An empty
table has no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_SQL, crc32_sql, cut, table

#: What a word is made of, after A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points and occurrences that a word has at least; one run in so many loses a letter; how many times more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, MUTATED, RATIO = 6, 5, 199, 5
#: Lengths of grams, places above which a gram is frequent, words above which a list is cut further.
SHORTEST, LONGEST_GRAM, FREQUENT, LONGEST = 2, 4, 256, 32
#: Different words that a task holds before it passes their counts on.
HELD = 1 << 18


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all runs of letters in docs (doc_id, text), one in 199 of them without one letter."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        frame = lambda: pd.DataFrame({"word": list(held), "n": list(held.values())})
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                before = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), before)
                    if h % MUTATED == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= least_length:
                        held[run] = held.get(run, 0) + n
            if len(held) > HELD:
                yield frame()
                held = {}
        if held:
            yield frame()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, places: int = FREQUENT) -> dict[str, int]:
    """The grams, shorter than the longest, that stand at more than so many places of words (word), and at how many."""
    found = None
    for size in range(SHORTEST, LONGEST_GRAM):
        grams = words.filter(F.length("word") >= size).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (size - 1)), lambda i: F.col("word").substr(i, F.lit(size)))).alias("gram"))
        found = grams if found is None else found.unionByName(grams)
    # At most 90^2 + 90^3 rows, whatever the number of words.
    return {r.gram: r.n for r in found.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > places).collect()}


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Start and length of the longest gram from each letter on."""
    out = []
    for start in range(len(word) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST_GRAM and start + size < len(word) and word[start : start + size] in frequent:
            size += 1
        out.append((start, size))
    return out


def affected(word: str, grams: list[tuple[int, int]], frequent: dict[str, int]) -> int:
    """The most grams that one edit can change: those over one letter, or those that only the word's end kept short."""
    over, cut_short = [0] * len(word), 0
    for start, size in grams:
        for i in range(start, start + size):
            over[i] += 1
        cut_short += start + size == len(word) and size < LONGEST_GRAM and word[start : start + size] in frequent
    return max(max(over, default=0), cut_short)


def merged_lists(word: str, frequent: dict[str, int]) -> list[tuple[int, int, int]]:
    """key, from, to: the lists that the word is in, and the letters that the key leaves open."""
    grams = decompose(word, frequent)
    if len(grams) - affected(word, grams, frequent) < 1:
        raise ValueError(f"a word of {len(word)} letters is too short for a bound")
    order = sorted(grams, key=lambda g: (frequent.get(word[g[0] : g[0] + g[1]], 0), word[g[0] : g[0] + g[1]], g[0]))
    out = []
    for start, size in order[: affected(word, grams, frequent) + 1]:
        end = start + size
        out.append((xxhash.xxh64_intdigest(f"<{start}:{word[:end]}") - (1 << 63), end, len(word)))
        out.append((xxhash.xxh64_intdigest(f">{size}:{word[start:]}") - (1 << 63), 0, start))
    return out


def postings(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """key, word, n, lo, hi: one row for each list that a word is in."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, word, n, lo, hi) for word, n in zip(pdf["word"], pdf["n"], strict=True) for key, lo, hi in merged_lists(word, frequent)]
            yield pd.DataFrame(rows, columns=["key", "word", "n", "lo", "hi"])

    return words.select("word", "n").mapInPandas(task, "key long, word string, n long, lo int, hi int")


def _without_one(rest: Column) -> Column:
    """Digests of rest and of rest without each of its letters."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.xxhash64(F.concat(rest.substr(F.lit(1), i - 1), rest.substr(i + 1, F.length(rest)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(rest)), F.when(F.length(rest) > 0, shorter).otherwise(F.array().cast("array<bigint>"))))


def near_pairs(words: DataFrame, places: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """a, n_a, b, n_b: each two words (word, n; kept, of six letters or more) one edit apart, once, a before b."""
    lists = cut(postings(words, frequent_grams(words, places)))
    sizes = lists.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rest = F.substring("word", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    place = F.explode(F.when(F.col("size") > longest, _without_one(rest)).otherwise(F.array(F.lit(0).cast("long"))))
    met = cut(lists.join(sizes, "key").select("key", "word", "n", place.alias("place")))
    a = met.select("key", "place", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = met.select("key", "place", F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = a.join(b, ["key", "place"]).filter(F.col("a") < F.col("b")).filter(F.levenshtein("a", "b", 1) == 1)
    return near.groupBy("a", "b").agg(F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))


def grouped(words: DataFrame, ratio: int = RATIO, places: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """word, n, n_near, form, form_n, root of words (word, n; kept)."""
    pairs = cut(near_pairs(words, places, longest))
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))
    )
    best = both.groupBy("word").agg(F.first("n_a").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    near = cut(best.select("word", "n_near", F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")))
    roots = cut(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    top = near.agg(F.max("form_n")).first()[0] or 1
    steps = int(math.log(top, ratio)) + 1  # each form is so many times more frequent
    for _ in range(steps.bit_length()):
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(cut(counted(table(spark, sf_dir, "documents"))))


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
spelled AS (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named FROM runs WHERE length(run) >= {LEAST_LENGTH}),
hexed AS (SELECT run, n, hex(encode(named)) AS x FROM spelled),
digested AS (
  SELECT run, n, {crc32_sql("list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)")} AS h FROM hexed, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {MUTATED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM digested)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, a.n, b.n AS n_other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, a.n, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, b.n, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n_other DESC, encode(other)) AS best, max(n_other) AS best_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near x ON x.word = w.word),
chains AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""

"""Quality rules: fixed base rules, then robust multivariate outliers by language and source.

Each text becomes a vector of transformed statistics. For each language and source a minimum
covariance determinant estimate is found from several starts: medians with absolute deviations, and
means with covariances of a few documents drawn by hash. From each, concentration steps follow: the
KEEP share of documents nearest to the centre gives the next mean and covariance, until the
determinant falls no more (by SETTLED of itself); the start that ends with the least determinant is
the estimate. A document whose Mahalanobis distance from it is past the cutoff is rejected.
Statistics are whole numbers (hundredths), so sums are exact and results do not depend on the order
in which they are added. A step is one aggregation: moments are summed for each distance, in
hundredths of its logarithm, and running sums over the distances show where the share is reached.

Everything about one text (words, repeated windows, repeated lines) is computed inside its row by
array functions, so no text is shuffled. Groups are aggregated before the shuffle; only one row a
group is joined back.

Defined results: a null or blank text has no words and fails the base rules; a null language or
source is a group of its own; documents that fail the base rules take no part in the estimates;
a group with fewer than LEAST_ROWS others is measured by the estimate of its language, or of all documents
where the language has too few as well, so every other document has a distance. Repeated rows count each time and
are judged alike. An empty table gives an empty result. `filter_docs` keeps all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, cut, table

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
KEEP, LEAST_ROWS = 0.75, 50
#: Documents of a random start, random starts, and the relative fall of a determinant that ends its steps.
DRAWN, RANDOM_STARTS, SETTLED = 10, 2, 1e-4
#: The share of Gaussian documents beyond the cutoff, and the least standard deviation of a
#: statistic: corpora have longer tails, most texts repeat nothing, and only what is far outside goes.
#: Where no other text has any, a share alone rejects from 46 % of symbols, 46 % of duplicate lines
#: or 22 % of repeated words (past 30 % the base rules do).
TAIL, LEAST_SD = 1e-8, (0.1, 0.1, 0.1, 0.1, 0.07)
SYMBOLS = "[^#*$%&|<>]+"
SCALE = 100


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Arrays that a step uses are columns of the step before and arguments, never captured whole in
    a lambda, so that each is computed once a row.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.withColumns(
        {
            "_q_words": F.array_remove(F.split(text, SPACES), ""),
            "_q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        }
    )
    two = one.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_h": F.transform("_q_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_q_words", "_q_lines")

    def doubled(df: DataFrame, shift: int) -> DataFrame:
        """_q_h[i] from the hashes of shift words at i and at i + shift."""
        rest = F.greatest(F.size("_q_h") - shift, F.lit(0))
        pairs = F.zip_with(F.slice("_q_h", F.lit(1), rest), F.slice("_q_h", F.lit(shift + 1), rest), lambda a, b: F.xxhash64(a, b))
        return df.withColumn("_q_h", pairs)

    hashed = doubled(doubled(doubled(two, 1), 2), 4)
    repeats = F.size(F.array_distinct("_q_h")) < F.size("_q_h")
    order = F.when(repeats, F.array_sort(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = hashed.withColumn("_q_s", order).drop("_q_h")
    same = lambda x, j: F.coalesce(F.get("_q_s", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_q_s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = ranked.withColumn("_q_p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_q_s")
    more = F.greatest(F.size("_q_p") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("_q_p", F.lit(2), more), F.slice("_q_p", F.lit(1), more), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)
    counted = starts.withColumn("n_repeat_words", F.when(F.size("_q_p") > 0, covered).otherwise(0).cast("long")).drop("_q_p")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics, in hundredths."""
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    parts = [
        F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")),
        F.log(F.greatest(F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(1.0)), F.lit(1.0))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]
    return [F.round(SCALE * x).cast("long") for x in parts]


DIMS = 5


def chi2_cdf(x: float, k: int) -> float:
    term = total = 1 / (k / 2)
    for n in range(1, 500):
        term *= (x / 2) / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def group_key() -> Column:
    return F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))


def lang_key() -> Column:
    return F.to_json(F.struct(F.col("lang").cast("string").alias("lang")))


#: A group, its language and all documents have estimates; the first letter keeps their keys apart.
EVERYTHING = "a"


def _own(g: Column) -> Column:
    return F.concat(F.lit("g"), g)


def _language(lang: Column) -> Column:
    return F.concat(F.lit("l"), lang)


def _squared_distance() -> str:
    """(x - mean)' C^-1 (x - mean) by forward substitution in the Cholesky factor of C, as an expression."""
    y: list[str] = []
    for i in range(DIMS):
        y.append(f"((x{i} - m{i}{''.join(f' - l{i}_{j} * {y[j]}' for j in range(i))}) / l{i}_{i})")
    return " + ".join(f"{v} * {v}" for v in y)


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
KEYS = ["g", "start"]


#: Number, sums and sums of products of vectors, as whole numbers. Long expressions are spelled, as building them call by call takes seconds.
SUMS = {"rows": "count(*)"} | {f"s{i}": f"sum(x{i})" for i in range(DIMS)} | {f"s{i}_{j}": f"sum(x{i} * x{j})" for i, j in PAIRS}
ESTIMATE = [*[f"m{i}" for i in range(DIMS)], *[f"l{i}_{j}" for i, j in PAIRS]]
LOG_DET = "2 * (" + " + ".join(f"ln(l{i}_{i})" for i in range(DIMS)) + ")"


def _moments() -> list[Column]:
    return [F.expr(f"{e} AS {n}") for n, e in SUMS.items()]


def _factored(sums: DataFrame, widen: float) -> DataFrame:
    """g, start, m0.., l00.., det: means, the Cholesky factor of the widened covariance, its log-determinant."""
    found = sums.selectExpr("*", *[f"s{i} / rows AS m{i}" for i in range(DIMS)])
    found = found.selectExpr(
        *KEYS, *ESTIMATE[:DIMS], *[f"(s{i}_{j} / rows - m{i} * m{j}) * {widen!r}D{f' + {(LEAST_SD[i] * SCALE) ** 2!r}D' * (i == j)} AS l{i}_{j}" for i, j in PAIRS]
    )
    for j in range(DIMS):  # a column of the factor from those before it
        taken = lambda i: "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))  # noqa: E731, B023
        root = f"sqrt(greatest(l{j}_{j}{taken(j)}, 1e-6D))"
        fresh = {f"l{i}_{j}": root if i == j else f"(l{i}_{j}{taken(i)}) / {root}" for i in range(j, DIMS)}
        found = found.selectExpr(*KEYS, *[f"{fresh.get(c, c)} AS {c}" for c in ESTIMATE])
    return found.selectExpr("*", f"{LOG_DET} AS det")


def _starts(vectors: DataFrame, widen: float) -> DataFrame:
    """g, start and the estimate that each start begins with."""
    middle = vectors.groupBy("g").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"c{i}") for i in range(DIMS)])
    middle = broadcast_if_small(cut(middle))
    deviation = vectors.join(middle, "g").groupBy("g").agg(
        *[F.percentile(F.round(F.abs(F.col(f"x{i}") - F.col(f"c{i}"))), F.lit(0.5)).alias(f"d{i}") for i in range(DIMS)]
    )
    scaled = middle.join(deviation, "g").select(
        "g",
        F.lit(0).alias("start"),
        *[F.col(f"c{i}").cast("double").alias(f"m{i}") for i in range(DIMS)],
        *[(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(LEAST_SD[i] * SCALE)) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in PAIRS],
    )
    # One vector of each bucket of a hash, the one of the least hash: a minimum that Spark takes before the shuffle.
    draws = vectors.withColumn("start", F.explode(F.array(*[F.lit(k + 1) for k in range(RANDOM_STARTS)]))).withColumn("h", F.xxhash64("key", "start"))
    drawn = draws.groupBy(*KEYS, F.pmod("h", F.lit(DRAWN)).alias("bucket")).agg(F.min(F.struct("h", *[f"x{i}" for i in range(DIMS)])).alias("x"))
    few = drawn.select(*KEYS, "x.*").groupBy(*KEYS).agg(*_moments())
    return scaled.selectExpr("*", f"{LOG_DET} AS det").unionByName(_factored(few, widen))


def estimates(vectors: DataFrame, keep: float = KEEP) -> DataFrame:
    """Minimum covariance determinant estimates of (g, key, x0..), one row a group; vectors is read once a step."""
    near = chi2_quantile(keep, DIMS)
    widen = keep / chi2_cdf(near, DIMS + 2)
    now = cut(_starts(vectors, widen).withColumn("moves", F.lit(True)))
    upto = Window.partitionBy(*KEYS).orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEYS)
    step = 0
    while now.filter("moves").limit(1).count():
        step += 1
        moving = broadcast_if_small(now.filter("moves"))
        measured = vectors.join(moving.drop("det", "moves"), "g").withColumn("far", F.floor(100 * F.log1p(distance())))
        rings = measured.groupBy(*KEYS, "far").agg(*_moments())
        # Rings before the one in which the share is reached, and that one.
        inside = rings.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0))).withColumn("all", F.sum("rows").over(whole)).filter(F.col("before") < keep * F.col("all"))
        sums = inside.groupBy(*KEYS).agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS])
        fresh = _factored(sums, widen)
        old = now.select(*[F.col(k).alias(f"old_{k}") for k in KEYS], F.col("det").alias("old_det"))
        # The first step leaves a start whose determinant is not comparable; from then on it can only fall.
        falls = F.lit(True) if step == 1 else F.col("det") < F.col("old_det") + math.log1p(-SETTLED)
        moved = fresh.join(old, (F.col("g") == F.col("old_g")) & (F.col("start") == F.col("old_start"))).withColumn("moves", falls)
        now = cut(moved.select(*now.columns).unionByName(now.filter("NOT moves")))
    best = now.groupBy("g").agg(F.min_by(F.struct(*now.columns[1:]), F.struct("det", "start")).alias("x")).select("g", "x.*")
    return cut(best.drop("moves", "start", "det"))


def distance() -> Column:
    return F.expr(_squared_distance())


def _vectors(statistics: DataFrame) -> DataFrame:
    return statistics.withColumns({"g": group_key(), "l": lang_key()} | {f"x{i}": x for i, x in enumerate(vector())})


def _levels(passed: DataFrame) -> DataFrame:
    """Each vector three times: g is its group's key, its language's, and that of all."""
    return passed.select(F.explode(F.array(_own(F.col("g")), _language(F.col("l")), F.lit(EVERYTHING))).alias("g"), "key", *[f"x{i}" for i in range(DIMS)])


def _judged(statistics: DataFrame, found: DataFrame, sizes: DataFrame, tail: float) -> DataFrame:
    """sizes has g, l and size of the groups."""
    cutoff = chi2_quantile(1 - tail, DIMS)
    languages = sizes.groupBy("l").agg(F.sum("size").alias("in_lang"))
    level = F.when(F.col("size") >= LEAST_ROWS, _own(F.col("g"))).when(F.col("in_lang") >= LEAST_ROWS, _language(F.col("l"))).otherwise(F.lit(EVERYTHING))
    measured_by = sizes.join(languages, "l").select(F.col("g").alias("_q_g"), level.alias("g"))
    known = broadcast_if_small(cut(measured_by.join(found, "g").drop("g")))
    far = statistics.join(known, F.col("g") == F.col("_q_g"), "left").withColumn("distance", distance())
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def row_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), group_key())


def _measure(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' numbers, kept in the shared folder; the estimates; the sizes of the groups.

    Nothing may filter the statistics before they are kept: a predicate pushed through them would
    repeat their expressions inside each other.
    """
    rows = _vectors(text_statistics(docs.select("doc_id", "text", "lang", "source", row_key().alias("key"))))
    kept = cut(rows.select("doc_id", "key", *NUMBERS, "base_failed", "g", "l", *[f"x{i}" for i in range(DIMS)]))
    passed = kept.filter(~F.col("base_failed"))
    return kept, estimates(_levels(passed)), passed.groupBy("g", "l").agg(F.count("*").alias("size"))


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, then n_lines and the squared distance, of every row."""
    kept, found, sizes = _measure(docs)
    return _judged(kept, found, sizes, tail).select("doc_id", *[c for c in NUMBERS if c != "n_lines"], "base_failed", "kept", "n_lines", "distance")


def filter_docs(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    rejected = _judged(*_measure(docs), tail).filter(~F.col("kept")).select(F.col("doc_id").alias("_q_doc"), F.col("key").alias("_q_key")).distinct()
    rejected = broadcast_if_small(cut(rejected))
    own = docs.withColumn("_q_own", row_key())
    same = F.col("doc_id").eqNullSafe(F.col("_q_doc")) & (F.col("_q_own") == F.col("_q_key"))
    return own.join(rejected, same, "left_anti").drop("_q_own")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))

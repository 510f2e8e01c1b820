"""Personal data: fixed base patterns, and contextual extraction bootstrapped from what they find.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Possessive
quantifiers and looks behind make each pattern linear in the text with the same matches. A match
is put between marks by one replacement, so that splitting at the marks gives matches and the
lengths before them, hence places in code points.

Bootstrapping: looser shapes of the same kinds (a phone without a plus sign, a card beside other
digits, an address without a dotted host) are candidates. Each place of an entity or candidate has
lexical patterns, each with the kind: the two words before it, the two words after it, its own shape
(digits as 9, letters as a, and whether its numbers pass the kind's test), its shape with the kind of
the entity beside it on either side, and its shape at a line's beginning or end. Patterns and
instances (kind and spelling) form a bipartite graph: a pattern's confidence is the share of all
places where it fits, in the whole corpus, that hold believed instances; an instance is believed as
far as its confident patterns say (noisy or), seeds fully. A few rounds let new instances raise
patterns of their own. A candidate in a confident pattern, itself believed, becomes a span.

Matches and the text between them become rows, a text's lengths are summed by a window over its
own rows, and so are its neighbours found: work grows with the matches, not with their square. Only
ids, lengths, matches and words beside them are shuffled, no text.

Defined results: a null text is empty and has no spans; spans are ordered by start, then kind as
listed; base spans are never changed, and added ones overlap none of them. Repeated rows each
get a row and are judged alike. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

KINDS = ("email", "ip", "card", "phone")
#: The stated patterns with possessive quantifiers; a start inside a run that failed from its first character fails too.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a match at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A candidate: an international or bracketed phone number, a card number in fours, or any token with a digit or an at sign.
LOOSE = (
    r"(?<![A-Za-z0-9@._%+()-])(?:"
    r"(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{4}(?: [0-9]{4}){3})(?![A-Za-z0-9@._%+()-])"
    r"|[A-Za-z._%+()-]*+[0-9@][A-Za-z0-9@._%+()-]*+)"
)
MARK, OTHER = "\ufffe", "\ufffd"

ROUNDS, LEAST_SUPPORT, CONFIDENT = 3, 3, 0.6


def parts_of(text: Column, pattern: str) -> Column:
    """What stands between the matches and the matches in turn, beginning and ending with the former. text holds no MARK."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)).cast("int")) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("double") <= 255, F.lit(False)))
    n = F.length(digits(match))
    return n.between(10, 15) if kind == "phone" else F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)


def loose_kind(token: Column) -> Column:
    """The kind that a candidate's shape suggests, as a number, or null."""
    n = F.length(digits(token))
    return (
        F.when(token.rlike("^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$") & (F.length(token) >= 6), 0)
        .when(token.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), 1)
        .when(token.rlike("^[0-9 -]+$") & n.between(12, 19), 2)
        .when(token.rlike(r"^[0-9+(). -]+$") & n.between(7, 15), 3)
    )


def shape(kind: Column, token: Column) -> Column:
    """How a candidate is spelled: runs are one sign in addresses, signs stay apart in numbers; and whether its numbers fit the kind."""
    runs = F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), "[A-Za-z]+", "a")
    signs = F.regexp_replace(token, "[0-9]", "9")
    fits = F.when(kind == 1, holds("ip", token)).when(kind == 2, holds("card", token)).otherwise(True)
    return F.concat_ws(":", kind.cast("string"), F.when(kind <= 1, runs).otherwise(signs), F.coalesce(fits, F.lit(False)).cast("string"))


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined, of array<struct<s, k, e>>."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


WORDS_EACH_SIDE = 2


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, row, and for each kind and the looser shapes the parts of the text, null where nothing matches.

    A part is its length, the match or null, and of a text between matches its first and last words and
    whether a line ends or begins there.
    """
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(OTHER))
    rows = docs.select("doc_id", text.alias("text")).withColumn("numeric", F.col("text").rlike("[0-9]"))
    able = {k: F.col("text").contains(NEEDS[k]) & (F.lit(True) if k == "email" else F.col("numeric")) for k in KINDS}
    able["loose"] = F.col("numeric") | F.col("text").contains("@")
    split = rows.withColumns({k: F.when(able[k], parts_of(F.col("text"), BASE.get(k, LOOSE))) for k in able}).drop("text", "numeric")

    def between(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.split(letters(x), " "))

    def sized(x: Column, i: Column, beside: bool) -> Column:
        words = between(x, i)
        known = [
            F.length(x).alias("n"),
            F.when(i % 2 == 1, x).alias("m"),
            (F.slice(words, F.lit(1), F.lit(WORDS_EACH_SIDE)) if beside else F.lit(None).cast("array<string>")).alias("first"),
            (F.slice(words, F.greatest(F.size(words) - WORDS_EACH_SIDE + 1, F.lit(1)), F.lit(WORDS_EACH_SIDE)) if beside else F.lit(None).cast("array<string>")).alias("last"),
            (F.when(x.rlike(r"^\s*\n") | (x == ""), True).otherwise(False) if beside else F.lit(False)).alias("ends"),
            (F.when(x.rlike(r"\n\s*$") | (x == ""), True).otherwise(False) if beside else F.lit(False)).alias("begins"),
        ]
        return F.struct(*known)

    def parted(k: str) -> Column:
        return F.when(F.size(k) > 1, F.transform(k, lambda x, i: sized(x, i, k == "loose")))

    held = {k: parted(k) for k in able}
    return split.withColumns(held)


def places(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict spans (row, s, k, e, m), and candidates (row, s, k, e, m, seed and their patterns' values); found is kept and numbered by row."""
    passes = [*KINDS, "loose"]
    each = F.array(*[F.struct(F.lit(i).alias("pass"), F.col(k).alias("parts")) for i, k in enumerate(passes)])
    sides = found.select("row", F.explode(F.filter(each, lambda x: x["parts"].isNotNull())).alias("x"))
    parts = sides.select("row", F.col("x.pass").alias("pass"), F.posexplode("x.parts").alias("at", "p")).select("row", "pass", "at", "p.*")
    line = Window.partitionBy("row", "pass").orderBy("at")
    start = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    beside = {"before": F.lag("last").over(line), "after": F.lead("first").over(line), "bol": F.lag("begins").over(line), "eol": F.lead("ends").over(line)}
    placed = cut(parts.withColumns({"s": start} | beside).filter("m IS NOT NULL").drop("first", "last", "begins", "ends", "at"))
    right = F.lit(False)
    for i, kind in enumerate(KINDS):
        right = right | ((F.col("pass") == i) & F.coalesce(holds(kind, F.col("m")), F.lit(False)))
    strict = placed.filter(right).select("row", "s", F.col("pass").alias("k"), (F.col("s") + F.col("n")).alias("e"), "m")

    core = F.regexp_replace("m", r"[.()%+-]+$", "")
    loose = placed.filter(F.col("pass") == len(KINDS)).withColumn("m", core).withColumn("k", loose_kind(F.col("m"))).withColumn("e", F.col("s") + F.length("m"))
    around = Window.partitionBy("row").orderBy("s", "e")
    touching = lambda words, other: F.when(F.array_join(words, "") == "", other)
    loose = loose.withColumns({"left": touching(F.col("before"), F.lag("k").over(around)), "right": touching(F.col("after"), F.lead("k").over(around))})
    # Sorted with the strict spans of its text, a candidate is free if none before it reaches into it and none after it begins in it.
    both = loose.withColumn("strict", F.lit(False)).unionByName(strict.withColumn("strict", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("row").orderBy("s", F.desc("strict"), "e")
    reached = F.max(F.when(F.col("strict"), F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min(F.when(F.col("strict"), F.col("s"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("s")) & (F.coalesce(begun, F.col("e")) >= F.col("e"))
    # A candidate that is a strict span itself stands right after it.
    same = F.max(F.when(F.col("strict"), F.struct("s", "e", "k"))).over(order.rowsBetween(-len(KINDS), -1)) == F.struct("s", "e", "k")
    told = both.withColumns({"free": free, "seed": F.coalesce(same, F.lit(False))}).filter("NOT strict AND k IS NOT NULL AND (free OR seed)")
    return strict, told.select("row", "s", "k", "e", "m", "seed", "before", "after", "bol", "eol", "left", "right", shape(F.col("k"), F.col("m")).alias("shape"))


def patterns_of(candidates: DataFrame) -> DataFrame:
    """One row for each pattern of each candidate: row, s, k, e, m, seed, type (words or form) and pat."""
    pair = lambda words: F.when((F.size(words) == WORDS_EACH_SIDE) & ~F.array_contains(words, ""), F.xxhash64(words[0], words[1]))
    form = lambda name, *c: F.when(~F.isnull(c[-1]), F.xxhash64(F.lit(name), *c))
    word = lambda x: F.struct(F.lit("words").alias("type"), x.alias("pat"))
    own = lambda x: F.struct(F.lit("form").alias("type"), x.alias("pat"))
    every = F.array(
        word(pair(F.col("before"))),
        word(pair(F.col("after"))),
        own(form("shape", "shape")),
        own(form("left", "shape", "left")),
        own(form("right", "shape", "right")),
        own(F.when(F.col("bol"), form("bol", "shape"))),
        own(F.when(F.col("eol"), form("eol", "shape"))),
    )
    return candidates.select("row", "s", "k", "e", "m", "seed", F.explode(F.filter(every, lambda x: x["pat"].isNotNull())).alias("x")).select("row", "s", "k", "e", "m", "seed", "x.*")


def bit_row(contexts: DataFrame) -> tuple[DataFrame, int]:
    """One row, bits (array of 64-bit words with the bit of each ctx set), and the number of bits: 2 MB at most."""
    size = 1 << min(24, max(16, (64 * contexts.count()).bit_length()))
    word = F.shiftrightunsigned(F.col("ctx").bitwiseAND(F.lit(size - 1)), 6)
    words = contexts.groupBy(word.alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(ctx & 63 as int)))").alias("b"))
    every = contexts.sparkSession.range(size // 64).join(words, "id", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x")).select(F.col("x.b").alias("bits")), size


def context_counts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """ctx, total: how often each pair of words in contexts (ctx, kept) stands in the corpus.

    A row's pairs pass a bit array first, inside the row, so that only those of the contexts, and few
    others, become rows of their own; the join then decides.
    """
    bits, size = bit_row(contexts)
    spelled = docs.select(F.split(letters(F.coalesce("text", F.lit(""))), " ").alias("w")).join(F.broadcast(cut(bits)), how="cross")  # one row
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(2), rest), lambda a, b: F.xxhash64(a, b))

    def known(h: Column) -> Column:
        word = F.shiftrightunsigned(h.bitwiseAND(F.lit(size - 1)), 6).cast("int")
        return F.bit_get(F.get("bits", word), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    places = spelled.select(F.explode(F.filter(pairs, known)).alias("ctx"))
    return places.join(broadcast_if_small(contexts), "ctx", "left_semi").groupBy("ctx").agg(F.count("*").alias("total"))


def bootstrap(docs: DataFrame, uses: DataFrame, rounds: int, support: int, confident: float) -> tuple[DataFrame, DataFrame] | None:
    """Confident patterns (type, pat, k), believed instances (k, m); None if no pattern has enough instances. uses is kept."""
    edges = cut(uses.groupBy("type", "pat", "k", "m").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    able = edges.groupBy("type", "pat", "k").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("type", "pat", "k")
    graph = cut(edges.join(broadcast_if_small(cut(able)), ["type", "pat", "k"]))
    if graph.isEmpty():
        return None
    # A form fits candidates only, so its places are counted among them; words may stand anywhere in the corpus.
    forms = graph.filter("type = 'form'").groupBy("type", "pat").agg(F.sum("n").alias("total"))
    contexts = cut(graph.filter("type = 'words'").groupBy(F.col("pat").alias("ctx")).agg(F.sum("n").alias("led")))
    if contexts.isEmpty():
        totals = cut(forms)
    else:
        # Common words first: what the documents that can hold an entity show is a bound from below on the total,
        # and words seen there too often to be confident, whatever is believed later, need no count elsewhere.
        early = context_counts(docs.filter(F.col("text").rlike("[0-9@]")), contexts.select("ctx"))
        rare = contexts.join(early, "ctx", "left").filter(confident * F.coalesce("total", F.lit(0)) <= F.col("led")).select("ctx")
        counted = context_counts(docs, cut(rare)).select(F.lit("words").alias("type"), F.col("ctx").alias("pat"), "total")
        totals = cut(forms.unionByName(counted))
    weighed = cut(graph.join(broadcast_if_small(totals), ["type", "pat"]))
    seeds = edges.groupBy("k", "m").agg(F.max("seed").alias("seed"))
    belief = seeds.select("k", "m", F.col("seed").cast("double").alias("belief"))
    for _ in range(rounds):
        scored = weighed.join(belief, ["k", "m"], "left")
        patterns = (
            scored.groupBy("type", "pat", "k")
            .agg((F.sum(F.col("n") * F.coalesce("belief", F.lit(0.0))) / F.max(F.greatest("total", "n"))).alias("score"), F.count_if(F.col("belief") > 0.5).alias("backed"))
            .filter((F.col("score") >= confident) & (F.col("backed") >= support))
            .select("type", "pat", "k", F.least("score", F.lit(0.999999)).alias("score"))
        )
        patterns = broadcast_if_small(cut(patterns))
        said = weighed.join(patterns, ["type", "pat", "k"]).groupBy("k", "m").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("said"))
        belief = cut(seeds.join(said, ["k", "m"], "left").select("k", "m", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("said", F.lit(0.0))).alias("belief")))
    # Only what stands somewhere outside the base spans is asked for.
    loose = uses.filter("NOT seed").select("k", "m").distinct()
    return patterns, broadcast_if_small(cut(belief.filter(F.col("belief") >= confident).join(loose, ["k", "m"], "left_semi").select("k", "m")))


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then n_added, of every row."""
    # Rows are numbered as they are kept, so a task that is run again numbers them alike.
    found = cut(marked(docs)).withColumn("row", F.monotonically_increasing_id())
    strict, candidates = places(found)
    strict, candidates = cut(strict), cut(candidates)
    span = F.struct("s", "k", "e")
    base = strict.groupBy("row").agg(F.collect_list(span).alias("base"))
    learned = bootstrap(docs, uses := patterns_of(candidates), rounds, support, confident)
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    full = found.select("doc_id", "row").join(base, "row", "left")
    if learned is None:
        full = full.withColumn("added", none)
    else:
        patterns, believed = learned
        hits = uses.filter("NOT seed").join(patterns, ["type", "pat", "k"]).join(believed, ["k", "m"]).groupBy("row").agg(F.collect_set(span).alias("added"))
        full = full.join(hits, "row", "left")
    full = full.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    number = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return full.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))

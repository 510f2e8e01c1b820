"""Registered queries over the catalogue view: grading, comparison, selection, dedup, search. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import comparison as cmp
from ..operators import dedup, quality, search, selection
from ..session import cut, table
from .adapters import EPOCH, SALT, STAR_SQL, key_sql, star

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return add


def with_star(sql: str) -> str:
    return "WITH " + STAR_SQL.strip() + sql


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


PICK_DATE = "2024-03-05"
GRADED_SQL = """
, scored AS (
  SELECT *, CAST((year <> 0)::INT + (len(genres) > 0)::INT + CASE WHEN len(actors) >= 2 THEN 2 WHEN len(actors) = 1 THEN 1 ELSE 0 END
    + (len(directors) > 0)::INT + (len(houses) > 0)::INT + (len(music) > 0)::INT + (len(writers) > 0)::INT AS INTEGER) AS score FROM star),
graded AS (
  SELECT *, year <> 0 AND len(directors) > 0 AND len(actors) >= 2 AND len(genres) >= 1 AND score >= 6 AS eligible FROM scored)
"""
KEYS_SQL = ", ".join(f"list_transform({c}, lambda x: {key_sql('x')}) AS k_{c}" for c in cmp.ARRAYS.values())
PICK_SQL = f"""
, ordered AS (
  SELECT movie_id, row_number() OVER (ORDER BY sha256('{SALT}:' || CAST(movie_id AS VARCHAR))) - 1 AS place, count(*) OVER () AS n FROM graded WHERE eligible),
pick AS (SELECT movie_id AS pick_id FROM ordered WHERE place = ((date_diff('day', DATE '{EPOCH}', DATE '{PICK_DATE}') % n) + n) % n),
keyed AS (SELECT *, {KEYS_SQL} FROM star),
pairs AS (
  SELECT g.*, m.movie_id AS m_id, m.year AS m_year, {", ".join(f"m.{c} AS m_{c}, m.k_{c} AS mk_{c}" for c in cmp.ARRAYS.values())}
  FROM keyed g CROSS JOIN (SELECT * FROM keyed WHERE movie_id = (SELECT pick_id FROM pick)) m),
commons AS (
  SELECT *, {", ".join(f"list_filter({c}, lambda x, i: k_{c}[i] <> '' AND list_contains(mk_{c}, k_{c}[i]) AND list_position(k_{c}, k_{c}[i]) = i) AS c_{a}" for a, c in cmp.ARRAYS.items())}
  FROM pairs),
compared AS (
  SELECT *, CASE WHEN year IS NULL OR m_year IS NULL THEN 'unknown' WHEN year = m_year THEN 'correct' ELSE 'absent' END AS year_status,
    CASE WHEN year IS NULL OR m_year IS NULL THEN 'unknown' WHEN year = m_year THEN 'same' WHEN m_year > year THEN 'later' ELSE 'earlier' END AS year_direction,
    {", ".join(f"CASE WHEN len({c}) = 0 OR len(m_{c}) = 0 THEN 'unknown' WHEN len(c_{a}) = 0 THEN 'absent' WHEN len(list_filter(k_{c}, lambda x: x <> '' AND NOT list_contains(mk_{c}, x))) = 0 AND len(list_filter(mk_{c}, lambda x: x <> '' AND NOT list_contains(k_{c}, x))) = 0 THEN 'correct' ELSE 'partial' END AS status_{a}" for a, c in cmp.ARRAYS.items())}
  FROM commons)
"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as narrow as grading needs them: movie_id, year, and arrays of the right sizes with nothing in them."""
    t = lambda name: table(spark, sf_dir, name)
    lines = (
        t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        .join(t("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").join(t("nation").select("n_nationkey"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    )
    rows = t("orders").select("o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    blank = lambda n: F.array_repeat(F.lit(""), n)
    some = blank(F.least(F.coalesce("n", F.lit(0)), F.lit(2)))
    return rows.select(
        F.col("o_orderkey").alias("movie_id"), F.year("o_orderdate").alias("year"), *[some.alias(c) for c in ("genres", "actors", "directors", "houses", "music")], blank(F.lit(1)).alias("writers")
    )


def picked(spark: SparkSession, sf_dir: str) -> int | None:
    """The id of the one work that the fixed date picks."""
    dates = spark.range(1).select(F.lit(PICK_DATE).cast("date").alias("game_date"))
    pool = quality.graded(counted(spark, sf_dir)).filter("eligible").select("movie_id")
    return selection.daily_picks(dates, cut(pool), SALT, EPOCH).first().movie_id


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work compared with the pick. The pick's id comes first and alone, so that one order's rows are read for it and all works are built once."""
    keyed = star(spark, sf_dir, keyed=True)
    hidden = cut(keyed.filter(F.col("movie_id") == F.lit(picked(spark, sf_dir))))
    return cmp.compare(cmp.side(keyed, "g").join(F.broadcast(cmp.side(hidden, "m")), how="cross"))  # one row


FLAGSHIP_SQL = with_star(
    GRADED_SQL
    + PICK_SQL
    + """
SELECT movie_id, title, movie_id = m_id AS is_correct,
  CAST(len(c_genre) + len(c_cast) + len(c_director) + len(c_production_house) + len(c_music_director) + len(c_writer) + (year_status = 'correct')::INT AS INTEGER) AS n_shared
FROM compared ORDER BY n_shared DESC, movie_id LIMIT 20
"""
)


@query("flagship_closest_works", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), F.col("g_title").alias("title"), "is_correct", cmp.n_shared().alias("n_shared"))
    return found.orderBy(F.desc("n_shared"), "movie_id").limit(20)


# --- comparison ---


@query("g1_year", with_star(GRADED_SQL + PICK_SQL + "SELECT movie_id, year_status, year_direction, CASE WHEN year_status = 'correct' THEN m_year END AS year_mystery FROM compared"))
def g1(spark, sf_dir):
    return compared(spark, sf_dir).select(
        F.col("g_movie_id").alias("movie_id"), F.col("year_result.status").alias("year_status"), F.col("year_result.direction").alias("year_direction"),
        F.col("year_result.mystery").alias("year_mystery"),
    )


@query("g2_overlap", with_star(GRADED_SQL + PICK_SQL + "SELECT movie_id, " + ", ".join(f"array_to_string(c_{a}, '|') AS common_{a}" for a in cmp.ARRAYS) + " FROM compared"))
def g2(spark, sf_dir):
    return compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), *[joined(f"common_{a}") for a in cmp.ARRAYS])


@query("g3_status", with_star(GRADED_SQL + PICK_SQL + "SELECT movie_id, " + ", ".join(f"status_{a}" for a in cmp.ARRAYS) + " FROM compared"))
def g3(spark, sf_dir):
    return compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), *[f"status_{a}" for a in cmp.ARRAYS])


@query(
    "g4_cast_positions",
    with_star(
        GRADED_SQL
        + PICK_SQL
        + """
SELECT movie_id, actors[i] AS name, CAST(i AS INTEGER) AS guess_position, CAST(list_position(mk_actors, k_actors[i]) AS INTEGER) AS mystery_position
FROM (SELECT movie_id, actors, k_actors, mk_actors, unnest(range(1, len(actors) + 1)) AS i FROM compared)
WHERE k_actors[i] <> '' AND list_contains(mk_actors, k_actors[i]) AND list_position(k_actors, k_actors[i]) = i
"""
    ),
)
def g4(spark, sf_dir):
    rows = compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), F.explode("cast_matches").alias("x"))
    return rows.select("movie_id", "x.name", "x.guess_position", "x.mystery_position")


@query(
    "g5_compare",
    with_star(
        GRADED_SQL
        + PICK_SQL
        + "SELECT movie_id, movie_id = m_id AS is_correct, year_status, "
        + ", ".join(f"status_{a}, CAST(len(c_{a}) AS INTEGER) AS n_{a}" for a in cmp.ARRAYS)
        + " FROM compared"
    ),
)
def g5(spark, sf_dir):
    counts = [F.size(f"common_{a}").alias(f"n_{a}") for a in cmp.ARRAYS]
    return compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), "is_correct", F.col("year_result.status").alias("year_status"), *[f"status_{a}" for a in cmp.ARRAYS], *counts)


@query(
    "g6_disclosed",
    with_star(
        GRADED_SQL
        + PICK_SQL
        + """SELECT movie_id, title, movie_id = m_id AS is_correct, year_status, year_direction, CASE WHEN year_status = 'correct' THEN m_year END AS year_mystery,
  CAST(len(c_cast) AS INTEGER) AS cast_count, status_genre, array_to_string(c_genre, '|') AS common_genre, CASE WHEN movie_id = m_id THEN m_id END AS mystery_id FROM compared"""
    ),
)
def g6(spark, sf_dir):
    shown = cmp.disclosed(compared(spark, sf_dir), F.col("is_correct"))
    return shown.select("movie_id", "title", "is_correct", "year_status", "year_direction", "year_mystery", "cast_count", "status_genre", joined("common_genre"), "mystery_id")


@query(
    "g7_revealed",
    with_star(
        GRADED_SQL
        + PICK_SQL
        + "SELECT movie_id, array_to_string(list_filter([CASE WHEN year_status = 'correct' THEN 'year' END, "
        + ", ".join(f"CASE WHEN len(c_{a}) > 0 THEN '{a}' END" for a in cmp.CREW)
        + "], lambda x: x IS NOT NULL), ',') AS revealed FROM compared"
    ),
)
def g7(spark, sf_dir):
    return compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), F.array_join(cmp.revealed(), ",").alias("revealed"))


@query(
    "g8_shared_values",
    with_star(
        GRADED_SQL
        + PICK_SQL
        + "SELECT movie_id, 'year' AS attribute, CAST(m_year AS VARCHAR) AS shared FROM compared WHERE year_status = 'correct' UNION ALL "
        + " UNION ALL ".join(f"SELECT movie_id, '{a}', array_to_string(c_{a}, '|') FROM compared WHERE len(c_{a}) > 0" for a in cmp.ARRAYS)
    ),
)
def g8(spark, sf_dir):
    rows = compared(spark, sf_dir).select(F.col("g_movie_id").alias("movie_id"), F.explode(cmp.shared_values()).alias("x"))
    return rows.filter(F.size("x.values") > 0).select("movie_id", "x.attribute", F.array_join("x.values", "|").alias("shared"))


# --- selection ---

SPINE_SQL = "(SELECT CAST(unnest(range(DATE '2023-12-01', DATE '2024-03-01', INTERVAL 1 DAY)) AS DATE) AS game_date)"


def spine(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-01").cast("date"), F.lit("2024-02-29").cast("date"))).alias("game_date"))


@query(
    "g23_daily_picks",
    with_star(GRADED_SQL + PICK_SQL + f"SELECT CAST(d.game_date AS VARCHAR) AS game_date, o.movie_id FROM {SPINE_SQL} d JOIN ordered o ON o.place = ((date_diff('day', DATE '{EPOCH}', d.game_date) % n) + n) % n"),
)
def g23(spark, sf_dir):
    picks = selection.daily_picks(spine(spark), cut(quality.graded(counted(spark, sf_dir)).filter("eligible").select("movie_id")), SALT, EPOCH)
    return picks.withColumn("game_date", F.col("game_date").cast("string"))


@query("g24_date_seed", f"SELECT o_orderkey AS movie_id, sha256('{SALT}-' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS seed FROM orders")
def g24(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("movie_id"), selection.date_seed(F.to_date("o_orderdate"), SALT).alias("seed"))


@query(
    "g25_pinned",
    with_star(
        GRADED_SQL
        + PICK_SQL
        + f""", pinned AS (SELECT CAST(o_orderdate AS DATE) + INTERVAL 28 YEAR AS d, min(o_orderkey) AS pin FROM orders GROUP BY 1)
SELECT CAST(s.game_date AS VARCHAR) AS game_date, coalesce(p.pin, o.movie_id) AS movie_id, p.pin IS NOT NULL AS pinned
FROM {SPINE_SQL} s JOIN ordered o ON o.place = ((date_diff('day', DATE '{EPOCH}', s.game_date) % n) + n) % n LEFT JOIN pinned p ON CAST(p.d AS DATE) = s.game_date"""
    ),
)
def g25(spark, sf_dir):
    pins = table(spark, sf_dir, "orders").groupBy(F.add_months("o_orderdate", 28 * 12).cast("string").alias("game_date")).agg(F.min("o_orderkey").alias("movie_id"))
    return selection.with_pinned(g23(spark, sf_dir), pins)


# --- quality ---

FIELD_SQL = {"genre": "genres", "cast": "actors", "director": "directors", "production_house": "houses", "music_director": "music", "writer": "writers"}


@query(
    "v4_missing_flags",
    with_star(
        "SELECT movie_id, " + ", ".join(f"CAST(len({c}) = 0 AS INTEGER) AS missing_{f}" for f, c in FIELD_SQL.items())
        + ", CAST(" + " + ".join(f"(len({c}) > 0)::INT" for c in FIELD_SQL.values()) + " + (coalesce(title, '') <> '')::INT + (coalesce(year, 0) <> 0)::INT AS INTEGER) AS n_filled FROM star"
    ),
)
def v4(spark, sf_dir):
    return quality.missing_flags(star(spark, sf_dir)).select("movie_id", *[f"missing_{f}" for f in FIELD_SQL], "n_filled")


COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (len({c}) = 0) AS missing, CAST(round_even(100.0 * (count(*) - count(*) FILTER (len({c}) = 0)) / count(*), 1) AS DOUBLE) AS coverage FROM star"
    for f, c in FIELD_SQL.items()
)


@query("v5_missing_counts", with_star(f"SELECT field, missing FROM ({COUNTS_SQL})"))
def v5(spark, sf_dir):
    return quality.missing_counts(star(spark, sf_dir)).select("field", "missing")


@query("v6_field_coverage", with_star(COUNTS_SQL))
def v6(spark, sf_dir):
    return quality.missing_counts(star(spark, sf_dir))


@query("v8_quality_score", with_star(GRADED_SQL + "SELECT movie_id, score FROM graded"))
def v8(spark, sf_dir):
    return quality.graded(star(spark, sf_dir)).select("movie_id", "score")


@query("v9_eligible", with_star(GRADED_SQL + "SELECT movie_id, coalesce(eligible, false) AS eligible FROM graded"))
def v9(spark, sf_dir):
    return quality.graded(star(spark, sf_dir)).select("movie_id", "eligible")


@query("v10_catalogue_counts", with_star(GRADED_SQL + "SELECT count(*) AS works, count(*) FILTER (eligible) AS eligible FROM graded"))
def v10(spark, sf_dir):
    return quality.catalogue_counts(star(spark, sf_dir))


def incoming(works: DataFrame) -> DataFrame:
    return works.withColumn("seq", F.col("movie_id")).withColumn("key", tx.search_key(F.col("title")))


def existing(works: DataFrame) -> DataFrame:
    """An older catalogue: every work with the year before its own, one a (key, year), the first."""
    rows = works.filter("title IS NOT NULL").withColumns({"seq": F.col("movie_id"), "key": tx.search_key(F.col("title")), "year": F.col("year") - 1})
    return dedup.first_by(rows, ["key", "year"])


SKEY = key_sql("replace(title, '&', ' and ')")
IMPORT_SQL = f"""
, incoming AS (SELECT *, {SKEY} AS key FROM graded),
classed AS (SELECT *, row_number() OVER (PARTITION BY key, year ORDER BY movie_id) AS n FROM incoming WHERE coalesce(trim(title), '') <> '' AND year IS NOT NULL),
existing AS (SELECT * REPLACE (CAST(year - 1 AS INTEGER) AS year) FROM (SELECT *, {SKEY} AS key, row_number() OVER (PARTITION BY {SKEY}, year ORDER BY movie_id) AS n FROM star WHERE title IS NOT NULL) WHERE n = 1)
"""


@query(
    "v11_import_summary",
    with_star(
        GRADED_SQL
        + IMPORT_SQL
        + """
SELECT count(*) FILTER (c.n = 1 AND e.key IS NULL) AS imported, count(*) FILTER (c.n = 1 AND e.key IS NOT NULL) AS updated, count(*) FILTER (c.n > 1) AS duplicates,
  CAST(sum(len(c.genres)) FILTER (c.n = 1) AS BIGINT) AS genre_rows, CAST(sum(len(c.actors)) FILTER (c.n = 1) AS BIGINT) AS cast_rows,
  count(*) FILTER (c.n = 1 AND c.eligible) AS eligible, (SELECT count(*) FROM incoming WHERE coalesce(trim(title), '') = '' OR year IS NULL) AS invalid,
  (SELECT coalesce(string_agg('row ' || CAST(movie_id AS VARCHAR) || ': empty name', '; ' ORDER BY movie_id), '') FROM (SELECT movie_id FROM incoming WHERE coalesce(trim(title), '') = '' ORDER BY movie_id LIMIT 10)) AS problems
FROM classed c LEFT JOIN existing e ON c.key = e.key AND c.year = e.year
"""
    ),
)
def v11(spark, sf_dir):
    works = star(spark, sf_dir)
    return quality.import_summary(incoming(works), existing(works))


@query("v12_year_slice", with_star("SELECT movie_id, year FROM star WHERE year BETWEEN 1996 AND 1998"))
def v12(spark, sf_dir):
    return quality.year_slice(star(spark, sf_dir), 1996, 1998, (1990, 2010)).select("movie_id", "year")


# --- dedup ---

SEQ_SQL = f"""
, named AS (
  SELECT *, movie_id AS seq, writers[1] AS url, {key_sql("title")} AS key,
    {" + ".join(f"(len({c}) > 0)::INT" for c in FIELD_SQL.values())} + (coalesce(title, '') <> '')::INT + (coalesce(year, 0) <> 0)::INT AS n_filled
  FROM star WHERE title IS NOT NULL),
firsts AS (SELECT *, first_value(key) OVER u AS fk, first_value(year) OVER u AS fy FROM named WINDOW u AS (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
canon AS (SELECT *, CASE WHEN url IS NOT NULL AND fy = year THEN fk ELSE key END AS ckey FROM firsts)
"""


def sequenced(works: DataFrame) -> DataFrame:
    """A number sign in an address begins a fragment, which names of writers do not mean."""
    rows = works.filter("title IS NOT NULL").withColumns({"seq": F.col("movie_id"), "key": tx.name_key(F.col("title"))})
    return quality.missing_flags(rows).withColumn("url", F.translate(F.get("writers", F.lit(0)), "#", "/"))


@query("d1_first_in_group", "SELECT p_brand, p_type, p_partkey, n_seen FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY p_brand, p_type) AS n_seen FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)) WHERE n = 1")
def d1(spark, sf_dir):
    return dedup.first_by(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey").select("p_brand", "p_type", "p_partkey", "n_seen")


@query(
    "d2_merge_candidates",
    with_star(
        SEQ_SQL
        + """SELECT ckey, year, min(seq) AS seq, count(*) AS n_merged, arg_min(title, seq) AS title, array_to_string(arg_min(houses, seq) FILTER (len(houses) > 0), '|') AS houses,
  array_to_string(arg_min(actors, seq) FILTER (len(actors) > 0), '|') AS actors FROM canon GROUP BY ckey, year"""
    ),
)
def d2(spark, sf_dir):
    merged = dedup.merge_candidates(sequenced(star(spark, sf_dir)), "key", "year", "url", ["title", "houses", "actors"])
    return merged.select("ckey", "year", "seq", "n_merged", "title", joined("houses"), joined("actors"))


@query(
    "d3_richest_record",
    with_star(
        SEQ_SQL
        + "SELECT ckey, year, movie_id, n_filled, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY ckey, year ORDER BY n_filled DESC, seq) AS n, count(*) OVER (PARTITION BY ckey, year) AS n_rows FROM canon) WHERE n = 1"
    ),
)
def d3(spark, sf_dir):
    return dedup.richest(sequenced(star(spark, sf_dir)), "key", "year", "url", "n_filled").select("ckey", "year", "movie_id", "n_filled", "n_rows")


@query("d4_import_dedup", with_star(GRADED_SQL + IMPORT_SQL + "SELECT key, year, min(movie_id) AS movie_id, count(*) AS n_seen FROM classed GROUP BY key, year"))
def d4(spark, sf_dir):
    rows = incoming(star(spark, sf_dir)).filter("coalesce(trim(title), '') <> '' AND year IS NOT NULL")
    return dedup.first_by(rows, ["key", "year"]).select("key", "year", "movie_id", "n_seen")


@query(
    "d5_upsert",
    with_star(
        GRADED_SQL
        + IMPORT_SQL
        + """, new AS (SELECT key, year, title, actors FROM classed WHERE n = 1),
both_ AS (
  SELECT coalesce(e.key, n.key) AS key, coalesce(e.year, n.year) AS year, e.movie_id AS old, CASE WHEN n.key IS NULL THEN e.title ELSE n.title END AS title,
    CASE WHEN n.key IS NULL THEN e.actors ELSE n.actors END AS actors, CASE WHEN n.key IS NULL THEN 'kept' WHEN e.key IS NULL THEN 'inserted' ELSE 'updated' END AS action
  FROM existing e FULL JOIN new n ON e.key = n.key AND e.year = n.year)
SELECT coalesce(old, (SELECT max(movie_id) FROM existing) + row_number() OVER (PARTITION BY action ORDER BY key, year)) AS movie_id, key, year, title, array_to_string(actors, '|') AS actors, action FROM both_
"""
    ),
)
def d5(spark, sf_dir):
    works = star(spark, sf_dir)
    rows = incoming(works).filter("coalesce(trim(title), '') <> '' AND year IS NOT NULL")
    cols = ["movie_id", "key", "year", "title", "actors"]
    done = dedup.upsert(existing(works).select(*cols), dedup.first_by(rows, ["key", "year"]).select(*cols), ["key", "year"], "movie_id")
    return done.withColumn("actors", F.array_join("actors", "|"))


@query(
    "d6_enqueue",
    "SELECT min(page_id) AS page_id, url FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/' AS url FROM pages WHERE url IS NOT NULL) WHERE url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY url",
)
def d6(spark, sf_dir):
    """The front pages of all addresses that the store does not hold."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("seq")).filter("url IS NOT NULL")
    fronts = pages.withColumn("url", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), F.lit("/")))
    return dedup.enqueue(pages, fronts, "url").select("page_id", "url")


CREDITS_SQL = f"""
, creds AS (SELECT *, {key_sql("title")} AS key FROM star WHERE title IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, year ORDER BY movie_id) AS n FROM creds) WHERE n = 1),
gaps AS (SELECT *, {key_sql("title")} AS key, CASE WHEN movie_id % 5 = 0 THEN [] ELSE actors END AS a, CASE WHEN movie_id % 7 = 0 THEN [] ELSE directors END AS d FROM star WHERE title IS NOT NULL)
"""


@query(
    "d11_fill_gaps",
    with_star(
        CREDITS_SQL
        + """SELECT g.movie_id, array_to_string(CASE WHEN len(g.a) = 0 THEN coalesce(b.actors[1:10], []) ELSE g.a END, '|') AS actors,
  array_to_string(CASE WHEN len(g.d) = 0 THEN coalesce(b.directors, []) ELSE g.d END, '|') AS directors,
  array_to_string(list_filter([CASE WHEN len(g.a) = 0 AND len(b.actors) > 0 THEN 'actors' END, CASE WHEN len(g.d) = 0 AND len(b.directors) > 0 THEN 'directors' END], lambda x: x IS NOT NULL), ',') AS filled
FROM gaps g LEFT JOIN best b ON g.key = b.key AND g.year = b.year"""
    ),
)
def d11(spark, sf_dir):
    works = star(spark, sf_dir).filter("title IS NOT NULL").withColumn("key", tx.name_key(F.col("title")))
    none = F.array().cast("array<string>")
    gaps = works.withColumns({"actors": F.when(F.col("movie_id") % 5 == 0, none).otherwise(F.col("actors")), "directors": F.when(F.col("movie_id") % 7 == 0, none).otherwise(F.col("directors"))})
    done = dedup.fill_gaps(gaps, works.withColumn("rank", F.col("movie_id")), ["actors", "directors"], "credits")
    return done.select("movie_id", joined("actors"), joined("directors"), F.array_join("filled", ",").alias("filled"))


@query("d13_sequential_ids", with_star("SELECT row_number() OVER (ORDER BY year, lower(title), movie_id) AS id, movie_id FROM star WHERE title IS NOT NULL"))
def d13(spark, sf_dir):
    works = star(spark, sf_dir).filter("title IS NOT NULL").withColumn("folded", F.lower("title"))
    return dedup.number(works.select("movie_id", "year", "folded"), ["year", "folded", "movie_id"]).select("id", "movie_id")


@query("d14_rebuild_arrays", with_star("SELECT movie_id, array_to_string(actors, '|') AS actors FROM star"))
def d14(spark, sf_dir):
    works = star(spark, sf_dir)
    children = works.select("movie_id", F.posexplode("actors").alias("pos", "actor"))
    return dedup.rebuild_arrays(works.select("movie_id"), children, "movie_id", "pos", "actor", "actors").select("movie_id", joined("actors"))


@query("d15_rejects", with_star(GRADED_SQL + "SELECT movie_id FROM graded WHERE NOT coalesce(eligible, false)"))
def d15(spark, sf_dir):
    works = quality.graded(star(spark, sf_dir))
    return dedup.rejects(works, works.filter("eligible"), "movie_id").select("movie_id")


# --- search ---

TITLES_SQL = f"WITH titles AS (SELECT p_partkey AS id, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, {key_sql('p_name')} AS key FROM part)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (1990 + F.col("p_size")).cast("int").alias("year"), tx.search_key(F.col("p_name")).alias("key"))


RANK_SQL = "CASE WHEN key = q OR replace(key, ' ', '') = replace(q, ' ', '') THEN 0 WHEN starts_with(key, q) THEN 1 ELSE 2 END"


@query("q1_title_search", TITLES_SQL + f"SELECT id, title, year, {RANK_SQL} AS rank FROM titles CROSS JOIN (SELECT 're' AS q) WHERE contains(key, q) ORDER BY rank, length(key), year DESC NULLS LAST, title, id LIMIT 12")
def q1(spark, sf_dir):
    return search.search(titles(spark, sf_dir), "Re!")


@query(
    "q2_batch_search",
    TITLES_SQL
    + f""", asked AS (SELECT n_nationkey AS query_id, lower(n_name) AS q FROM nation UNION ALL SELECT 100 + p_partkey, substr(key_, 2, 5) FROM (SELECT p_partkey, {key_sql('p_name')} AS key_ FROM part)),
hits AS (SELECT query_id, id, {RANK_SQL} AS rank, row_number() OVER (PARTITION BY query_id ORDER BY {RANK_SQL}, length(key), year DESC NULLS LAST, title, id) AS place
  FROM (SELECT query_id, trim(q) AS q FROM asked) JOIN titles ON contains(key, q) OR (replace(q, ' ', '') <> q AND contains(replace(key, ' ', ''), replace(q, ' ', ''))) WHERE q <> '')
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS INTEGER) AS place, id, rank FROM hits WHERE place <= 12""",
)
def q2(spark, sf_dir):
    names = titles(spark, sf_dir)
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lower("n_name").alias("query"))
    pieces = names.select((F.col("id") + 100).cast("long").alias("query_id"), F.substring("key", 2, 5).alias("query"))
    return search.batch_search(names, asked.unionByName(pieces))


@query("q3_catalogue", TITLES_SQL + "SELECT id, title, key, year FROM titles ORDER BY id")
def q3(spark, sf_dir):
    return search.catalogue(titles(spark, sf_dir))

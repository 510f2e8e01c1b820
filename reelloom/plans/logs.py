"""Registered queries over the guess log and the attempt log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison as cmp
from ..operators import dedup, queue, replay, search
from ..session import cut, shared_dir, table
from ..sources import files
from .adapters import ATTEMPT_SQL, EPOCH, GUESS_SQL, STAR_SQL, attempts, guess_events, index, key_sql, n_works, star

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return add


# --- the guess log ---

KEYS_SQL = ", ".join(f"list_transform({c}, lambda x: {key_sql('x')}) AS k_{c}" for c in cmp.ARRAYS.values())
REPLAY_SQL = (
    "WITH "
    + STAR_SQL.strip()
    + ","
    + GUESS_SQL
    + """,
e AS (
  SELECT l.*, m.mystery_index, p.pool_index IS NOT NULL AS known, l.kind = 'guess' AND p.pool_index IS NOT NULL AS usable,
         l.kind = 'guess' AND p.pool_index IS NOT NULL AND l.pool_index = m.mystery_index AS correct
  FROM events_log l JOIN mystery m USING (session_id) LEFT JOIN pool p ON p.pool_index = l.pool_index),
first1 AS (SELECT session_id, pool_index, min(seq) AS seq FROM e WHERE usable GROUP BY ALL),
rank1 AS (SELECT session_id, seq, pool_index, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM first1),
hit1 AS (SELECT r.session_id, min(r.seq) AS hit FROM rank1 r JOIN e USING (session_id, seq) WHERE r.r <= 7 AND e.correct GROUP BY r.session_id),
acc1 AS (SELECT r.* FROM rank1 r LEFT JOIN hit1 h USING (session_id) WHERE r.r <= 7 AND (h.hit IS NULL OR r.seq <= h.hit)),
seventh AS (SELECT a.session_id, a.seq AS t7 FROM acc1 a LEFT JOIN hit1 h USING (session_id) WHERE a.r = 7 AND h.hit IS NULL),
bonus AS (SELECT e.session_id, min(e.seq) AS bonus_seq FROM e JOIN seventh s USING (session_id) WHERE e.kind = 'unlock' AND e.seq > s.t7 GROUP BY e.session_id),
first2 AS (
  SELECT e.session_id, e.pool_index, min(e.seq) AS seq FROM e JOIN bonus b USING (session_id)
  WHERE e.usable AND e.seq > b.bonus_seq AND NOT EXISTS (SELECT 1 FROM acc1 a WHERE a.session_id = e.session_id AND a.pool_index = e.pool_index) GROUP BY ALL),
rank2 AS (SELECT session_id, seq, pool_index, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM first2),
hit2 AS (SELECT r.session_id, min(r.seq) AS hit FROM rank2 r JOIN e USING (session_id, seq) WHERE r.r <= 3 AND e.correct GROUP BY r.session_id),
acc2 AS (SELECT r.* FROM rank2 r LEFT JOIN hit2 h USING (session_id) WHERE r.r <= 3 AND (h.hit IS NULL OR r.seq <= h.hit)),
accepted AS (SELECT session_id, seq, pool_index, r AS attempt FROM acc1 UNION ALL SELECT session_id, seq, pool_index, r + 7 FROM acc2),
ends AS (
  SELECT s.session_id, coalesce(h1.hit, h2.hit) AS won_seq, coalesce(h1.hit, h2.hit, l.seq) AS done_seq, t.t7, b.bonus_seq
  FROM (SELECT DISTINCT session_id FROM e) s LEFT JOIN hit1 h1 USING (session_id) LEFT JOIN hit2 h2 USING (session_id) LEFT JOIN (SELECT * FROM acc2 WHERE r = 3) l USING (session_id)
  LEFT JOIN seventh t USING (session_id) LEFT JOIN bonus b USING (session_id)),
played AS (
  SELECT e.*, a.attempt, x.won_seq, x.done_seq, x.t7, x.bonus_seq, (SELECT count(*) FROM accepted c WHERE c.session_id = e.session_id AND c.seq < e.seq) AS used_before
  FROM e JOIN ends x USING (session_id) LEFT JOIN accepted a ON a.session_id = e.session_id AND a.seq = e.seq),
coded AS (
  SELECT *, CASE
    WHEN kind = 'guess' AND attempt IS NULL THEN CASE WHEN seq > done_seq THEN 'game_complete' WHEN seq > t7 AND (bonus_seq IS NULL OR seq < bonus_seq) THEN 'no_attempts' WHEN NOT known THEN 'movie_not_found' ELSE 'duplicate_guess' END
    WHEN kind = 'unlock' THEN CASE WHEN seq > bonus_seq THEN 'bonus_already' WHEN seq > won_seq THEN 'game_complete' WHEN used_before < 7 THEN 'bonus_too_early' END END AS code
  FROM played),
outcome AS (
  SELECT session_id, min(game_date) AS game_date, CAST(count(attempt) AS INTEGER) AS used, max(bonus_seq) AS bonus_seq, count(code) AS refused,
    CASE WHEN max(won_seq) IS NOT NULL THEN 'won' WHEN max(done_seq) IS NOT NULL THEN 'lost' ELSE 'active' END AS status,
    greatest(CAST(floor(epoch(max(ts) FILTER (seq = done_seq)) - epoch(min(ts))) AS BIGINT), 0) AS secs, max(done_seq) IS NOT NULL AS ended
  FROM coded GROUP BY session_id),
keyed AS (SELECT *, """
    + KEYS_SQL
    + """ FROM pool),
pairs AS (
  SELECT a.session_id, a.seq, a.attempt, g.*, m.movie_id AS m_id, m.year AS m_year, """
    + ", ".join(f"m.{c} AS m_{c}, m.k_{c} AS mk_{c}" for c in cmp.ARRAYS.values())
    + """
  FROM accepted a JOIN mystery y USING (session_id) JOIN keyed g ON g.pool_index = a.pool_index JOIN keyed m ON m.pool_index = y.mystery_index),
compared AS (
  SELECT *, CASE WHEN year = m_year THEN 'same' WHEN m_year > year THEN 'later' ELSE 'earlier' END AS direction, """
    + ", ".join(
        f"list_filter({c}, lambda x, i: k_{c}[i] <> '' AND list_contains(mk_{c}, k_{c}[i]) AND list_position(k_{c}, k_{c}[i]) = i) AS c_{a}" for a, c in cmp.ARRAYS.items()
    )
    + """
  FROM pairs),
earned AS (
    SELECT session_id, seq, 'year' AS attribute, 0 AS cell FROM compared WHERE year = m_year
    """
    + "".join(
        f"UNION ALL SELECT session_id, seq, '{a}', i - 1 FROM (SELECT session_id, seq, c_{a}, m_{c}, unnest(range(1, len(m_{c}) + 1)) AS i FROM compared) WHERE "
        + (f"len(c_{a}) > 0 " if a in cmp.CREW else f"list_contains(c_{a}, m_{c}[i]) ")
        for a, c in cmp.ARRAYS.items()
    )
    + """),
cells AS (SELECT DISTINCT session_id, attribute, CAST(cell AS INTEGER) AS cell FROM earned),
sizes AS (SELECT session_id, attribute, n_cells FROM mystery JOIN (
    SELECT pool_index, 'year' AS attribute, 1 AS n_cells FROM pool WHERE coalesce(year, 0) <> 0
    """
    + "".join(f"UNION ALL SELECT pool_index, '{a}', len({c}) FROM pool WHERE len({c}) > 0 " for a, c in cmp.ARRAYS.items())
    + """) ON pool_index = mystery_index)
"""
)


def log(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The log, replayed once and kept for all that a query asks of it. Of the works only the ids are needed."""
    return cut(replay.replay(guess_events(spark, sf_dir), index(spark, sf_dir) if ids is None else ids))


def works_of(spark: SparkSession, sf_dir: str, replayed: DataFrame, ids: DataFrame) -> DataFrame:
    """The keyed works that a log names: the accepted guesses and the mysteries. No others are built, however large the catalogue."""
    named = replayed.filter("attempt IS NOT NULL").select("pool_index").unionByName(replayed.select(F.col("mystery_index").alias("pool_index"))).distinct()
    own = cut(ids.join(named, "pool_index"))
    return cut(cmp.with_keys(star(spark, sf_dir, own.select("movie_id")).join(own, "movie_id")))


def played(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The replayed log and its works."""
    ids = index(spark, sf_dir)
    replayed = log(spark, sf_dir, ids)
    return replayed, works_of(spark, sf_dir, replayed, ids)


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.compared_guesses(*played(spark, sf_dir))


@query("g9_replay", REPLAY_SQL + "SELECT session_id, seq, kind, CAST(attempt AS INTEGER) AS attempt, code FROM coded WHERE kind = 'guess'")
def g9(spark, sf_dir):
    return log(spark, sf_dir).filter("kind = 'guess'").select("session_id", "seq", "kind", "attempt", "code")


@query("g10_bonus", REPLAY_SQL + "SELECT session_id, seq, code FROM coded WHERE kind = 'unlock'")
def g10(spark, sf_dir):
    return log(spark, sf_dir).filter("kind = 'unlock'").select("session_id", "seq", "code")


@query("g11_lifelines_unlocked", REPLAY_SQL + "SELECT session_id, seq, CAST((used_before >= 4)::INT + (used_before >= 6)::INT AS INTEGER) AS unlocked FROM coded WHERE kind = 'lifeline'")
def g11(spark, sf_dir):
    rows = log(spark, sf_dir).filter("kind = 'lifeline'")
    return rows.select("session_id", "seq", replay.lifelines_unlocked(F.col("used_before")).alias("unlocked"))


@query("g12_revealed_cells", REPLAY_SQL + "SELECT session_id, attribute, cell FROM cells")
def g12(spark, sf_dir):
    return replay.revealed_cells(replay.cells_by_guess(guesses(spark, sf_dir)))


ORDER_SQL = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(cmp.ATTRIBUTES)) + " END"


@query(
    "g13_purchasable",
    REPLAY_SQL
    + f"""SELECT m.session_id, coalesce(string_agg(s.attribute, ',' ORDER BY {ORDER_SQL.replace('attribute', 's.attribute', 1)}) FILTER (coalesce(c.n, 0) < s.n_cells), '') AS available
FROM mystery m LEFT JOIN sizes s USING (session_id) LEFT JOIN (SELECT session_id, attribute, count(*) AS n FROM cells GROUP BY ALL) c ON c.session_id = m.session_id AND c.attribute = s.attribute
GROUP BY m.session_id""",
)
def g13(spark, sf_dir):
    replayed, works = played(spark, sf_dir)
    cells = replay.revealed_cells(replay.cells_by_guess(replay.compared_guesses(replayed, works)))
    hidden = replayed.select("session_id", "mystery_index").distinct()
    return replay.purchasable(hidden, cells, replay.sizes_by_work(works))


REFUSED_SQL = """CASE WHEN seq > done_seq THEN 'game_complete' WHEN {used} >= 2 THEN 'no_lifelines' WHEN {used} >= slots THEN 'lifeline_locked' WHEN attribute NOT IN ('year', 'genre', 'cast', 'director', 'production_house', 'music_director', 'writer') THEN 'bad_attribute'
  WHEN len({seen}) >= total THEN 'attribute_unavailable' WHEN value_index NOT BETWEEN 0 AND total - 1 THEN 'bad_value_index' WHEN list_contains({seen}, value_index) THEN 'cell_already_revealed' END"""
BOUGHT_SQL = "coalesce(value_index, list_min(list_filter(range(total), lambda i: NOT list_contains({seen}, CAST(i AS INTEGER)))))"
CLUES_SQL = f""",
asked AS (
  SELECT l.session_id, l.seq, l.done_seq, CAST((l.used_before >= 4)::INT + (l.used_before >= 6)::INT AS INTEGER) AS slots, CAST(CASE WHEN l.event_id % 3 = 0 THEN l.event_id % 5 END AS INTEGER) AS value_index,
    CASE WHEN l.event_id % 8 = 7 THEN 'budget' ELSE ['year', 'genre', 'cast', 'director', 'production_house', 'music_director', 'writer'][CAST(least(l.event_id % 8, 6) + 1 AS INTEGER)] END AS attribute
  FROM coded l WHERE l.kind = 'lifeline'),
known AS (SELECT a.session_id, a.seq, list(DISTINCT CAST(x.cell AS INTEGER)) AS seen FROM asked a JOIN earned x ON x.session_id = a.session_id AND x.attribute = a.attribute AND x.seq < a.seq GROUP BY a.session_id, a.seq),
priced AS (
  SELECT a.*, coalesce(s.n_cells, 0) AS total, coalesce(k.seen, []) AS seen FROM asked a LEFT JOIN sizes s ON s.session_id = a.session_id AND s.attribute = a.attribute LEFT JOIN known k ON k.session_id = a.session_id AND k.seq = a.seq),
one AS (
  SELECT session_id, min(seq) AS seq_1, arg_min(attribute, seq) AS attribute_1, arg_min({BOUGHT_SQL.format(seen="seen")}, seq) AS cell_1 FROM priced WHERE {REFUSED_SQL.format(used=0, seen="seen")} IS NULL GROUP BY session_id),
later AS (
  SELECT p.*, seq_1, coalesce(p.seq > seq_1, false) AS after_1, CASE WHEN p.seq > seq_1 AND attribute = attribute_1 AND NOT list_contains(seen, CAST(cell_1 AS INTEGER)) THEN list_append(seen, CAST(cell_1 AS INTEGER)) ELSE seen END AS seen_1 FROM priced p LEFT JOIN one USING (session_id)),
two AS (SELECT session_id, min(seq) AS seq_2 FROM later WHERE after_1 AND {REFUSED_SQL.format(used=1, seen="seen_1")} IS NULL GROUP BY session_id),
told AS (
  SELECT *, {REFUSED_SQL.format(used="used", seen="seen_1")} AS code FROM (SELECT l.*, after_1::INT + coalesce(l.seq > seq_2, false)::INT AS used FROM later l LEFT JOIN two USING (session_id)))
SELECT session_id, seq, attribute, CASE WHEN code IS NULL THEN CAST({BOUGHT_SQL.format(seen="seen_1")} AS INTEGER) END AS cell, CASE WHEN code IS NULL THEN CAST(used + 1 AS INTEGER) END AS number, code FROM told"""


@query("g14_clues", REPLAY_SQL + CLUES_SQL)
def g14(spark, sf_dir):
    replayed, works = played(spark, sf_dir)
    return replay.clues(replayed, replay.cells_by_guess(replay.compared_guesses(replayed, works)), replay.sizes_by_work(works))


@query(
    "g15_sessions",
    REPLAY_SQL
    + """SELECT session_id, status, used, CAST(greatest(7 + CASE WHEN bonus_seq IS NOT NULL THEN 3 ELSE 0 END - used, 0) AS INTEGER) AS remaining,
  CAST(7 + CASE WHEN bonus_seq IS NOT NULL THEN 3 ELSE 0 END AS INTEGER) AS max_attempts, bonus_seq IS NOT NULL AS bonus_unlocked,
  bonus_seq IS NULL AND used >= 7 AND status <> 'won' AS bonus_available, CAST((used >= 4)::INT + (used >= 6)::INT AS INTEGER) AS lifelines_unlocked,
  CASE WHEN ended THEN secs END AS duration_seconds, refused FROM outcome""",
)
def g15(spark, sf_dir):
    return replay.sessions(log(spark, sf_dir)).drop("game_date")


@query("g16_history", REPLAY_SQL + "SELECT session_id, CAST(attempt AS INTEGER) AS attempt, movie_id, title, movie_id = m_id AS is_correct, direction FROM compared")
def g16(spark, sf_dir):
    return replay.history(guesses(spark, sf_dir)).select("session_id", "attempt", "movie_id", "title", "is_correct", "direction")


@query(
    "g17_stats",
    REPLAY_SQL
    + "SELECT count(*) AS started, count(*) FILTER (status <> 'active') AS completed, count(*) FILTER (status = 'won') AS won, count(*) FILTER (status = 'lost') AS lost, CAST(round_even(avg(used) FILTER (status = 'won'), 2) AS DOUBLE) AS average_attempts FROM outcome",
)
def g17(spark, sf_dir):
    return replay.stats(replay.sessions(log(spark, sf_dir)))


FIRST, LAST = "2023-12-01", "2024-03-31"


@query(
    "g18_archive",
    REPLAY_SQL
    + f"""SELECT CAST(d.day AS VARCHAR) AS game_date, CASE max(CASE status WHEN 'won' THEN 3 WHEN 'lost' THEN 2 WHEN 'active' THEN 1 END) WHEN 3 THEN 'won' WHEN 2 THEN 'lost' WHEN 1 THEN 'in_progress' ELSE 'not_played' END AS status
FROM (SELECT CAST(unnest(range(DATE '{FIRST}', DATE '{LAST}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN outcome o ON o.game_date = d.day GROUP BY d.day""",
)
def g18(spark, sf_dir):
    found = replay.archive(replay.sessions(log(spark, sf_dir)), FIRST, LAST)
    return found.withColumn("game_date", F.col("game_date").cast("string"))


@query(
    "g19_date_requests",
    """WITH r AS (SELECT event_id, CAST(ts AS DATE) AS server, CAST(ts AS DATE) + CAST(event_id % 5 - 2 AS INTEGER) AS client, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 7 - 3 AS INTEGER) END AS asked FROM events),
t AS (SELECT *, CASE WHEN abs(client - server) <= 1 THEN client ELSE server END AS today FROM r)
SELECT event_id, CASE WHEN coalesce(asked, today) > today THEN 'future_date' WHEN coalesce(asked, today) < DATE '2024-01-10' THEN 'before_archive_start' ELSE 'ok' END AS answer FROM t""",
)
def g19(spark, sf_dir):
    day = F.to_date("ts")
    client = F.date_add(day, (F.col("event_id") % 5 - 2).cast("int"))
    asked = F.when(F.col("event_id") % 3 != 0, F.date_add(day, (F.col("event_id") % 7 - 3).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", replay.date_request(asked, client, day, "2024-01-10").alias("answer"))


def _flat(a: str) -> str:
    return f"coalesce(array_to_string(list_filter(flatten(list(c_{a} ORDER BY attempt)), lambda x, i: list_position(flatten(list(c_{a} ORDER BY attempt)), x) = i), '|'), '') AS \"{a}\""


BOARD_SQL = """, flat AS (SELECT session_id, greatest(1990, coalesce(max(year + 1) FILTER (direction = 'later'), 1990)) AS year_low, least(2030, coalesce(min(year - 1) FILTER (direction = 'earlier'), 2030)) AS year_high,
  max(year) FILTER (direction = 'same') AS year_exact, """ + ", ".join(f"flatten(list(c_{a} ORDER BY attempt)) AS f_{a}" for a in cmp.ARRAYS) + """ FROM compared GROUP BY session_id)
SELECT session_id, CAST(year_low AS INTEGER) AS year_low, CAST(year_high AS INTEGER) AS year_high, year_exact, """ + ", ".join(f"coalesce(array_to_string(list_filter(f_{a}, lambda x, i: list_position(f_{a}, x) = i), '|'), '') AS \"{a}\"" for a in cmp.ARRAYS) + " FROM flat"


@query("g20_board", REPLAY_SQL + BOARD_SQL)
def g20(spark, sf_dir):
    return replay.board(guesses(spark, sf_dir), 1990, 2030)


@query(
    "g21_shared_groups",
    REPLAY_SQL
    + "SELECT session_id, CAST(attempt AS INTEGER) AS attempt, 'year' AS attribute, CAST(m_year AS VARCHAR) AS shared FROM compared WHERE year = m_year UNION ALL "
    + " UNION ALL ".join(f"SELECT session_id, CAST(attempt AS INTEGER), '{a}', array_to_string(c_{a}, '|') FROM compared WHERE len(c_{a}) > 0" for a in cmp.ARRAYS),
)
def g21(spark, sf_dir):
    return replay.shared_groups(guesses(spark, sf_dir))


@query("g22_puzzle_number", f"SELECT event_id, CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) + 1 AS INTEGER) AS number FROM events")
def g22(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", replay.puzzle_number(F.to_date("ts"), EPOCH).alias("number"))


OFFERED = 12


@query(
    "q4_not_guessed",
    REPLAY_SQL
    + f"""SELECT o.session_id, p.movie_id FROM (SELECT session_id, (mystery_index + unnest(range({OFFERED}))) % n AS i FROM mystery CROSS JOIN size) o JOIN pool p ON p.pool_index = o.i
WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.session_id = o.session_id AND a.pool_index = p.pool_index)""",
)
def q4(spark, sf_dir):
    """Of the titles offered to each session, a list of fixed length from its mystery on, those not yet guessed."""
    ids = index(spark, sf_dir)
    replayed = log(spark, sf_dir, ids)
    steps = F.explode(F.sequence(F.lit(0), F.lit(OFFERED - 1)))
    rows = replayed.select("session_id", "mystery_index").distinct().withColumn("step", steps)
    offered = rows.withColumn("pool_index", F.pmod(F.col("mystery_index") + F.col("step"), F.lit(n_works(spark, sf_dir))).cast("int")).join(ids, "pool_index")
    return search.not_guessed(offered, replayed.filter("attempt IS NOT NULL"), ["session_id", "pool_index"]).select("session_id", "movie_id")


# --- the attempt log ---

STATE_SQL = (
    "WITH "
    + ATTEMPT_SQL
    + """, queue AS (
  SELECT url, min(year) AS year, min(name) AS name, coalesce(arg_max(outcome, seq) FILTER (outcome <> 'pending'), 'pending') AS status, count(*) FILTER (outcome <> 'pending') AS attempts,
    max(ts) FILTER (outcome <> 'pending') AS last_attempt, left(arg_max(coalesce(error, ''), seq) FILTER (outcome <> 'pending'), 1000) AS last_error FROM attempts GROUP BY url)
"""
)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.state(attempts(spark, sf_dir))


@query("w1_pending", STATE_SQL + "SELECT url, year, name FROM queue WHERE status = 'pending' ORDER BY year, name, url")
def w1(spark, sf_dir):
    return queue.pending(state(spark, sf_dir)).select("url", "year", "name")


@query("w1_pending_of_years", STATE_SQL + "SELECT url, year, name FROM queue WHERE status = 'pending' AND year IN (2003, 2011) ORDER BY year, name, url LIMIT 50")
def w1y(spark, sf_dir):
    return queue.pending(state(spark, sf_dir), [2003, 2011], 50).select("url", "year", "name")


@query("w2_failed", STATE_SQL + "SELECT url, attempts, year FROM queue WHERE status = 'failed'")
def w2(spark, sf_dir):
    return queue.failed(state(spark, sf_dir)).select("url", "attempts", "year")


@query("w2_successful", STATE_SQL + "SELECT url, year, name FROM queue WHERE status = 'success'")
def w2s(spark, sf_dir):
    return queue.successful(state(spark, sf_dir)).select("url", "year", "name")


@query("w3_by_year", STATE_SQL + "SELECT year, count(*) AS total, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM queue GROUP BY year")
def w3(spark, sf_dir):
    return queue.by_year(state(spark, sf_dir))


@query("w4_state", STATE_SQL + "SELECT url, status, attempts, CAST(epoch_us(last_attempt) AS BIGINT) AS last_attempt_us, CASE WHEN status = 'failed' THEN last_error END AS error FROM queue")
def w4(spark, sf_dir):
    return state(spark, sf_dir).select("url", "status", "attempts", F.unix_micros("last_attempt").alias("last_attempt_us"), "error")


@query("w5_requeued", STATE_SQL + "SELECT url, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status FROM queue")
def w5(spark, sf_dir):
    return queue.requeue_failed(state(spark, sf_dir)).select("url", "status")


@query("w6_counters", STATE_SQL + "SELECT count(*) AS queued, count(*) FILTER (attempts > 0) AS tried, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, CAST(sum(attempts) AS BIGINT) AS attempts FROM queue")
def w6(spark, sf_dir):
    """Counted while the queue is written."""
    run = files.Run(f"{shared_dir(spark)}/files-{uuid.uuid4().hex}")
    kept = run.write(state(spark, sf_dir), "queue", **files.states(tried=F.count_if(F.col("attempts") > 0)))
    seen = run["queue"]
    named = {"queued": "rows", "tried": "tried", "succeeded": "success", "failed": "failed", "attempts": "attempts"}
    return kept.sparkSession.range(1).select(*[F.lit(seen[c]).cast("long").alias(n) for n, c in named.items()])


@query("d16_latest_status", "WITH " + ATTEMPT_SQL + "SELECT year, arg_max(outcome, seq) AS outcome, arg_max(url, seq) AS url FROM attempts GROUP BY year")
def d16(spark, sf_dir):
    return dedup.latest(attempts(spark, sf_dir), "year", F.col("seq"), ["outcome", "url"])

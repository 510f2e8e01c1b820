"""The window replay against a sequential fold, clues against the rules, and the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from reelloom.operators import comparison as cmp
from reelloom.operators import replay


def fold(events, mystery, known):
    status, used, bonus, taken, out = "active", 0, False, [], {}
    for seq, kind, p in events:
        if kind == "unlock":
            code = "bonus_already" if bonus else "game_complete" if status == "won" else "bonus_too_early" if used < 7 else None
            bonus = bonus or code is None
            out[seq] = (None, code)
            continue
        code = "game_complete" if status != "active" else "no_attempts" if used >= 7 + 3 * bonus else "movie_not_found" if p not in known else "duplicate_guess" if p in taken else None
        if code is None:
            taken.append(p)
            used += 1
            status = "won" if p == mystery else "lost" if bonus and used >= 10 else "active"
        out[seq] = (used if code is None else None, code)
    return out, (status, used, bonus)


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(3)
    rows, want, ends, hidden = [], {}, {}, []
    seq = 0
    for s in range(150):
        mystery = rng.randrange(14)
        log = []
        for _ in range(rng.randint(0, 30)):
            seq += 1
            log.append((seq, "unlock" if rng.random() < 0.15 else "guess", rng.randrange(16)))
        out, end = fold(log, mystery, set(range(14)))
        want |= {(f"s{s}", q): v for q, v in out.items()}
        if log:
            ends[f"s{s}"] = end
        hidden.append((f"s{s}", mystery))
        rows += [(f"s{s}", q, k, p) for q, k, p in log]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "session_id string, seq long, kind string, pool_index int")
    events = events.withColumns({"game_date": F.lit("2024-01-01").cast("date"), "ts": F.timestamp_seconds(F.col("seq"))})
    known = spark.range(14).select(F.col("id").cast("int").alias("pool_index"))
    return events, known, spark.createDataFrame(hidden, "session_id string, mystery_index int"), want, ends


def test_every_event(logs):
    events, known, hidden, want, ends = logs
    replayed = replay.replay(events, known, hidden).cache()
    assert {(r.session_id, r.seq): (r.attempt, r.code) for r in replayed.collect()} == want
    got = {r.session_id: (r.status, r.used, r.bonus_unlocked) for r in replay.sessions(replayed).collect()}
    assert got == ends


def test_stream_equals_batch(spark, logs, tmp_path):
    from reelloom.streaming import jobs

    events, known, hidden, _, ends = logs
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    flagged = events.join(hidden, "session_id").join(known.withColumn("known", F.lit(True)), "pool_index", "left").fillna(False, ["known"])
    rows = flagged.select("session_id", "seq", "kind", "pool_index", "mystery_index", "known").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    middle = 1200
    rows.filter(F.col("seq") <= middle).coalesce(1).write.parquet(str(tmp_path / "log"))
    out = str(tmp_path / "out")

    def run():
        stream = jobs.file_stream(spark, str(tmp_path / "log"), rows.schema)
        q = jobs.session_states(stream).writeStream.foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}"))
        q.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    rows.filter(F.col("seq") > middle).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run()
    last = spark.read.parquet(out).groupBy("session_id").agg(F.max_by(F.struct("status", "used", "bonus_unlocked"), "n").alias("x"))
    assert {r.session_id: tuple(r.x) for r in last.collect()} == ends


def test_sessions_close_and_state_stays_small(spark, tmp_path):
    """50 batches of sessions that each last three: the state holds those of the last few batches, late events fold in place, too late ones do not."""
    import random

    from reelloom.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    rng = random.Random(3)
    batches, want = 50, {}
    held = [[] for _ in range(batches)]
    for s in range(batches):
        events = [(s * 1000 + i, s * 3600 + i * 600, "unlock" if rng.random() < 0.1 else "guess", rng.randint(0, 12), 5, rng.random() < 0.9) for i in range(18)]
        want[f"s{s}"] = jobs.fold([(e[0], *e[2:]) for e in events])
        for seq, at, *rest in events:
            held[min(batches - 1, at // 3600 + rng.choice([0, 0, 1]))].append((f"s{s}", seq, at, *rest))
    held[40].append(("s2", 2999, 2 * 3600 + 3000, "guess", 5, 5, True))  # its session has long been closed
    schema = "session_id string, seq long, at_s long, kind string, pool_index int, mystery_index int, known boolean"
    log, out, sizes = str(tmp_path / "log"), str(tmp_path / "out"), []
    for rows in held:
        rng.shuffle(rows)
        part = spark.createDataFrame(rows, schema)
        part.withColumn("ts", F.timestamp_seconds(F.col("at_s") + 1_700_000_000)).drop("at_s").coalesce(1).write.mode("append").parquet(log)
    stream = jobs.file_stream(spark, log, spark.read.parquet(log).schema, maxFilesPerTrigger="1")

    def write(batch, n):
        batch.withColumn("n", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{out}/b={n}")

    query = jobs.session_states(stream, "2 hours", 1 / 12).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= batches and max(sizes[-20:]) <= 1.5 * max(sizes[:20]) < 300  # of 900 events
    rows = spark.read.parquet(out).collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.n, r.closed)):
        last[r.session_id] = ((r.status, r.used, r.bonus_unlocked, tuple(map(int, r.accepted.split(","))) if r.accepted else ()), r.closed)
    assert {s: v for s, (v, _) in last.items()} == want
    assert sum(closed for _, closed in last.values()) >= batches - 8


def work(i, year, genres, actors, directors):
    return (i, i, f"T{i}", year, genres, actors, directors, [], [], [])


@pytest.fixture(scope="module")
def game(spark):
    works = [work(0, 2015, ["Drama", "Action"], ["Actor A", "Actor B", "Actor C"], ["Dir"]), work(1, 2015, [], ["Actor C"], []), work(2, 2001, [], [], ["Dir"]), *[work(i, 1990 + i, [], [f"N{i}"], [f"E{i}"]) for i in range(3, 9)]]
    schema = "pool_index int, movie_id long, title string, year int, genres array<string>, actors array<string>, directors array<string>, houses array<string>, music array<string>, writers array<string>"
    return cmp.with_keys(spark.createDataFrame(works, schema))


def play(spark, game, log):
    """log: (kind, pool_index, attribute, cell)"""
    rows = [("s", i, *x) for i, x in enumerate(log)]
    events = spark.createDataFrame(rows, "session_id string, seq long, kind string, pool_index int, attribute string, value_index int")
    events = events.withColumns({"game_date": F.lit("2024-01-01").cast("date"), "ts": F.timestamp_seconds(F.col("seq"))})
    hidden = spark.createDataFrame([("s", 0)], "session_id string, mystery_index int")
    replayed = replay.replay(events, game, hidden)
    compared = replay.compared_guesses(replayed, game)
    return replayed, compared, replay.clues(replayed, replay.cells_by_guess(compared), replay.sizes_by_work(game))


def test_clue_rules(spark, game):
    g = lambda p: ("guess", p, None, None)
    buy = lambda a, n=None: ("lifeline", None, a, n)
    log = [buy("cast"), g(1), g(3), g(4), buy("cast"), g(5), buy("budget"), buy("year"), buy("music_director"), buy("cast", 9), buy("cast", 2), buy("cast", 1), buy("cast"), g(6), g(7), buy("cast", 1), buy("cast"), buy("genre"), g(0), buy("genre")]
    _, compared, bought = play(spark, game, log)
    got = [(r.attribute, r.cell, r.code) for r in bought.orderBy("seq").collect()]
    assert got == [
        ("cast", None, "lifeline_locked"), ("cast", None, "lifeline_locked"), ("budget", None, "bad_attribute"), ("year", None, "attribute_unavailable"),
        ("music_director", None, "attribute_unavailable"), ("cast", None, "bad_value_index"), ("cast", None, "cell_already_revealed"), ("cast", 1, None),
        ("cast", None, "lifeline_locked"), ("cast", None, "cell_already_revealed"), ("cast", 0, None), ("genre", None, "no_lifelines"), ("genre", None, "game_complete"),
    ]
    board = replay.board(compared.filter("attempt < 7"), 1990, 2030).first()
    assert (board.year_exact, board.year_low, board.year_high, board.cast) == (2015, 1998, 2030, "Actor C")


def test_archive_and_dates(spark):
    rows = [("2024-01-01", "lost"), ("2024-01-01", "won"), ("2024-01-03", "active"), ("2025-01-01", "won")]
    found = spark.createDataFrame(rows, "game_date string, status string").withColumn("game_date", F.col("game_date").cast("date"))
    assert {str(r.game_date): r.status for r in replay.archive(found, "2024-01-01", "2024-01-03").collect()} == {"2024-01-01": "won", "2024-01-02": "not_played", "2024-01-03": "in_progress"}
    day = lambda s: F.lit(s).cast("date")
    ask = lambda a, c: spark.range(1).select(replay.date_request(day(a), day(c), day("2024-05-10"), "2024-01-01").alias("x")).first().x
    assert [ask(None, "2024-05-11"), ask("2024-05-11", "2024-05-11"), ask("2025-05-11", "2025-06-14"), ask("2023-12-31", None)] == ["ok", "ok", "future_date", "before_archive_start"]

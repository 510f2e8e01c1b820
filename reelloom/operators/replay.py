"""Replaying a guess log: accepted guesses, refusals, bonus, clues, session outcomes and roll-ups.

The log is events (session_id, seq, ts, kind, pool_index, ...); works is a pool with pool_index;
mystery gives each session's hidden work. All replay is by windows on the session key and by
minima over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut
from .comparison import ARRAYS, ATTRIBUTES, attribute_values, compare, revealed, shared_values, side

BASE, BONUS, FIRST_CLUE, SECOND_CLUE, MOST_CLUES = 7, 3, 4, 6, 2


def _session() -> WindowSpec:
    return Window.partitionBy("session_id")


def replay(events: DataFrame, known: DataFrame, mystery: DataFrame | None = None) -> DataFrame:
    """Every event with attempt (if accepted), code (if refused), correct, t7, bonus_seq, done_seq.

    mystery has each session's mystery_index; without it that is a column of events.

    Phase 1 takes the first seven different known works; phase 2, after the first unlock that
    follows the seventh, three more that phase 1 did not take, counted within the phase.
    """
    hidden = events if mystery is None else events.join(mystery, "session_id")
    e = (
        hidden.join(known.select("pool_index", F.lit(True).alias("exists")), "pool_index", "left")
        .withColumn("correct", (F.col("kind") == "guess") & F.col("exists") & (F.col("pool_index") == F.col("mystery_index")))
        .withColumn("usable", (F.col("kind") == "guess") & F.coalesce("exists", F.lit(False)))
    )
    by_work = Window.partitionBy("session_id", "usable", "pool_index").orderBy("seq")
    upto = _session().orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    one = e.withColumn("fresh", F.col("usable") & (F.row_number().over(by_work) == 1))
    one = one.withColumn("r1", F.when(F.col("fresh"), F.sum(F.col("fresh").cast("int")).over(upto)))
    hit1 = F.min(F.when(F.col("correct") & (F.col("r1") <= BASE), F.col("seq"))).over(_session())
    one = one.withColumn("hit1", hit1)
    one = one.withColumn("a1", F.coalesce((F.col("r1") <= BASE) & (F.col("hit1").isNull() | (F.col("seq") <= F.col("hit1"))), F.lit(False)))
    one = one.withColumn("t7", F.when(F.col("hit1").isNull(), F.min(F.when(F.col("a1") & (F.col("r1") == BASE), F.col("seq"))).over(_session())))
    one = one.withColumn("bonus_seq", F.min(F.when((F.col("kind") == "unlock") & (F.col("seq") > F.col("t7")), F.col("seq"))).over(_session()))
    taken1 = F.max(F.col("a1").cast("int")).over(Window.partitionBy("session_id", "usable", "pool_index")) == 1
    two = one.withColumn("late", F.col("usable") & F.coalesce(F.col("seq") > F.col("bonus_seq"), F.lit(False)) & ~taken1)
    by_late = Window.partitionBy("session_id", "late", "pool_index").orderBy("seq")
    two = two.withColumn("fresh2", F.col("late") & (F.row_number().over(by_late) == 1))
    two = two.withColumn("r2", F.when(F.col("fresh2"), F.sum(F.col("fresh2").cast("int")).over(upto)))
    two = two.withColumn("hit2", F.min(F.when(F.col("correct") & (F.col("r2") <= BONUS), F.col("seq"))).over(_session()))
    two = two.withColumn("a2", F.coalesce((F.col("r2") <= BONUS) & (F.col("hit2").isNull() | (F.col("seq") <= F.col("hit2"))), F.lit(False)))
    spent = F.min(F.when(F.col("a2") & (F.col("r2") == BONUS), F.col("seq"))).over(_session())
    two = two.withColumn("done_seq", F.coalesce("hit1", "hit2", spent))
    attempt = F.when(F.col("a1"), F.col("r1")).when(F.col("a2"), F.col("r2") + BASE).cast("int")
    three = two.withColumn("attempt", attempt)
    three = three.withColumn("used_before", F.coalesce(F.count("attempt").over(_session().orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    after = F.coalesce(F.col("seq") > F.col("done_seq"), F.lit(False))
    dry = F.coalesce((F.col("seq") > F.col("t7")) & (F.col("bonus_seq").isNull() | (F.col("seq") < F.col("bonus_seq"))), F.lit(False))
    refused_guess = F.when(after, "game_complete").when(dry, "no_attempts").when(F.col("exists").isNull(), "movie_not_found").otherwise("duplicate_guess")
    won = F.coalesce("hit1", "hit2")
    unlocked = F.coalesce(F.col("seq") > F.col("bonus_seq"), F.lit(False))
    refused_unlock = F.when(unlocked, "bonus_already").when(F.coalesce(F.col("seq") > won, F.lit(False)), "game_complete").when(F.col("used_before") < BASE, "bonus_too_early")
    code = F.when(F.col("kind") == "guess", F.when(F.col("attempt").isNull(), refused_guess)).when(F.col("kind") == "unlock", refused_unlock)
    keep = [c for c in events.columns if c not in ("pool_index", "mystery_index")]
    return three.select(*keep, "pool_index", "mystery_index", "attempt", code.alias("code"), "correct", "t7", "bonus_seq", "done_seq", won.alias("won_seq"), "used_before")


def lifelines_unlocked(used: Column) -> Column:
    """G11."""
    return (used >= FIRST_CLUE).cast("int") + (used >= SECOND_CLUE).cast("int")


def sessions(replayed: DataFrame) -> DataFrame:
    """G15 without clues: one row a session."""
    grouped = replayed.groupBy("session_id", "game_date").agg(
        F.count("attempt").cast("int").alias("used"),
        F.max("bonus_seq").alias("bonus_seq"),
        F.max("won_seq").alias("won_seq"),
        F.max("done_seq").alias("done_seq"),
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("seq") == F.col("done_seq"), F.col("ts"))).alias("completed_at"),
        F.count("code").alias("refused"),
    )
    unlocked = F.col("bonus_seq").isNotNull()
    most = F.lit(BASE) + F.when(unlocked, BONUS).otherwise(0)
    status = F.when(F.col("won_seq").isNotNull(), "won").when(F.col("done_seq").isNotNull(), "lost").otherwise("active")
    seconds = F.greatest(F.floor(F.unix_micros("completed_at") / 1_000_000 - F.unix_micros("started_at") / 1_000_000), F.lit(0))
    return grouped.select(
        "session_id",
        "game_date",
        status.alias("status"),
        "used",
        F.greatest(most - F.col("used"), F.lit(0)).cast("int").alias("remaining"),
        most.cast("int").alias("max_attempts"),
        unlocked.alias("bonus_unlocked"),
        (~unlocked & (F.col("used") >= BASE) & (status != "won")).alias("bonus_available"),
        lifelines_unlocked(F.col("used")).alias("lifelines_unlocked"),
        F.when(F.col("completed_at").isNotNull(), seconds.cast("long")).alias("duration_seconds"),
        "refused",
    )


def compared_guesses(replayed: DataFrame, works: DataFrame) -> DataFrame:
    """Accepted guesses with everything that G5 says of them; works is the keyed pool. Spark broadcasts it if it is small."""
    taken = replayed.filter("attempt IS NOT NULL").select("session_id", "game_date", "seq", "attempt", "pool_index", "mystery_index")
    guess, hidden = side(works, "g"), side(works, "m")
    return compare(taken.join(guess, F.col("pool_index") == F.col("g_pool_index")).join(hidden, F.col("mystery_index") == F.col("m_pool_index")))


def history(compared: DataFrame) -> DataFrame:
    """G16."""
    return compared.select(
        "session_id", "attempt", F.col("g_movie_id").alias("movie_id"), F.col("g_title").alias("title"), "is_correct",
        F.col("year_result.direction").alias("direction"), *[F.col(f"status_{a}") for a in ARRAYS],
    )


def cells_by_guess(compared: DataFrame) -> DataFrame:
    """G12, the part that guesses earn: session_id, seq, attribute, cell (from 0), rows not distinct.

    An attribute revealed in full gives all its cells; otherwise a cell counts where a shared value is
    spelled exactly as the mystery spells it.
    """
    rows = compared.select("session_id", "seq", revealed().alias("full"), F.explode(F.arrays_zip(attribute_values("m_").alias("m"), shared_values().alias("s"))).alias("x"))
    cell = rows.select("session_id", "seq", F.col("x.m.attribute").alias("attribute"), F.col("x.s.values").alias("shared"), "full", F.posexplode("x.m.values").alias("cell", "value"))
    return cell.filter(F.array_contains("full", F.col("attribute")) | F.array_contains("shared", F.col("value"))).select("session_id", "seq", "attribute", "cell")


def sizes_by_work(works: DataFrame) -> DataFrame:
    """pool_index, attribute, n_cells, of attributes that hold something."""
    rows = works.select("pool_index", F.explode(attribute_values()).alias("x"))
    return rows.select("pool_index", "x.attribute", F.size("x.values").alias("n_cells")).filter("n_cells > 0")


def clues(replayed: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """session_id, seq, attribute, cell, number, code: every lifeline event with the cell it bought or the code of its refusal.

    A session buys twice at most. The first purchase is the first event that would buy if none had
    before; the second the first after it that would buy with the first one's cell known. Both are
    minima by session, reduced before the shuffle, and met by a join; no task holds a session's log.
    What guesses had earned of an attribute comes to an event as one array, no longer than the
    attribute has cells.
    """
    events = replayed.filter("kind = 'lifeline'").select(
        "session_id", "seq", "mystery_index", "attribute", "value_index", lifelines_unlocked(F.col("used_before")).alias("slots"), F.coalesce(F.col("seq") > F.col("done_seq"), F.lit(False)).alias("over")
    )
    first = cells.groupBy("session_id", "attribute", "cell").agg(F.min("seq").alias("since"))
    earned = first.groupBy("session_id", "attribute").agg(F.collect_list(F.struct("since", "cell")).alias("earned"))
    asked = events.join(earned, ["session_id", "attribute"], "left").join(sizes.withColumnRenamed("pool_index", "mystery_index"), ["mystery_index", "attribute"], "left")
    seen = F.transform(F.filter(F.coalesce("earned", F.array().cast("array<struct<since:bigint,cell:int>>")), lambda x: x.since < F.col("seq")), lambda x: x.cell)
    asked = cut(asked.select("session_id", "seq", "attribute", "value_index", "slots", "over", F.coalesce("n_cells", F.lit(0)).alias("total"), seen.alias("seen")))

    named = F.col("value_index")

    def refusal(used: Column, seen: Column) -> Column:
        return (
            F.when(F.col("over"), "game_complete")
            .when(used >= MOST_CLUES, "no_lifelines")
            .when(used >= F.col("slots"), "lifeline_locked")
            .when(F.col("attribute").isNull() | ~F.col("attribute").isin(ATTRIBUTES), "bad_attribute")
            .when(F.size(seen) >= F.col("total"), "attribute_unavailable")
            .when(named.isNotNull() & ~((named >= 0) & (named < F.col("total"))), "bad_value_index")
            .when(named.isNotNull() & F.array_contains(seen, F.coalesce(named, F.lit(-1))), "cell_already_revealed")
        )

    def cell(seen: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0))), lambda i: ~F.array_contains(seen, i))
        return F.coalesce(named, F.array_min(free))

    def purchase(rows: DataFrame, used: int, seen: Column, name: str) -> DataFrame:
        bought = F.min(F.struct(F.col("seq"), F.col("attribute"), cell(seen).alias("cell")))
        return rows.filter(refusal(F.lit(used), seen).isNull()).groupBy("session_id").agg(bought.alias(name))

    one = asked.join(purchase(asked, 0, F.col("seen"), "one"), "session_id", "left")
    after = F.coalesce(F.col("seq") > F.col("one.seq"), F.lit(False))
    known = F.when(after & (F.col("attribute") == F.col("one.attribute")), F.array_union("seen", F.array("one.cell"))).otherwise(F.col("seen"))
    both = one.join(purchase(one.filter(after), 1, known, "two"), "session_id", "left")
    used = after.cast("int") + F.coalesce(F.col("seq") > F.col("two.seq"), F.lit(False)).cast("int")
    code = refusal(used, known)
    bought = code.isNull()
    return both.select("session_id", "seq", "attribute", F.when(bought, cell(known)).alias("cell"), F.when(bought, used + 1).alias("number"), code.alias("code"))


def revealed_cells(cells: DataFrame, bought: DataFrame | None = None) -> DataFrame:
    """session_id, attribute, cell, each once."""
    rows = cells.select("session_id", "attribute", "cell")
    if bought is not None:
        rows = rows.unionByName(bought.filter("code IS NULL").select("session_id", "attribute", "cell"))
    return rows.distinct()


def purchasable(session_mystery: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """session_id, available: attributes with data and a hidden cell, in display order."""
    counted = cells.groupBy("session_id", "attribute").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, ATTRIBUTES)), F.col("attribute"))
    left = (
        session_mystery.join(sizes, F.col("mystery_index") == F.col("pool_index"))
        .join(counted, ["session_id", "attribute"], "left")
        .filter(F.coalesce("n", F.lit(0)) < F.col("n_cells"))
        .groupBy("session_id")
        .agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), "attribute"))).alias("x"))
    )
    return session_mystery.select("session_id").join(left, "session_id", "left").select("session_id", F.coalesce(F.array_join("x.attribute", ","), F.lit("")).alias("available"))


def stats(found: DataFrame) -> DataFrame:
    """G17."""
    return found.agg(
        F.count("*").alias("started"),
        F.count_if(F.col("status") != "active").alias("completed"),
        F.count_if(F.col("status") == "won").alias("won"),
        F.count_if(F.col("status") == "lost").alias("lost"),
        F.bround(F.avg(F.when(F.col("status") == "won", F.col("used"))), 2).alias("average_attempts"),
    )


def archive(found: DataFrame, first: str, last: str) -> DataFrame:
    """Every date of the spine with won, lost, in_progress or not_played, in this order of precedence."""
    spark = found.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("game_date"))
    rank = F.when(F.col("status") == "won", 3).when(F.col("status") == "lost", 2).otherwise(1)
    best = found.groupBy("game_date").agg(F.max(rank).alias("rank"))
    named = F.when(F.col("rank") == 3, "won").when(F.col("rank") == 2, "lost").when(F.col("rank") == 1, "in_progress").otherwise("not_played")
    return F.broadcast(spine).join(best, "game_date", "right").unionByName(spine.join(best, "game_date", "left_anti").withColumn("rank", F.lit(None).cast("int"))).filter(
        F.col("game_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ).select("game_date", named.alias("status"))


def date_request(asked: Column, client: Column, server: Column, start: str) -> Column:
    """Ok, future_date or before_archive_start; the client's date counts only within a day of the server's."""
    today = F.when(F.abs(F.datediff(client, server)) <= 1, client).otherwise(server)
    wanted = F.coalesce(asked, today)
    return F.when(wanted > today, "future_date").when(wanted < F.lit(start).cast("date"), "before_archive_start").otherwise("ok")


def board(compared: DataFrame, floor: int, ceiling: int) -> DataFrame:
    """Per session the narrowed years, the exact year, and confirmed values of each attribute in order of attempt."""
    direction, year = F.col("year_result.direction"), F.col("g_year")
    groups = {a: F.sort_array(F.collect_list(F.struct("attempt", f"common_{a}"))) for a in ARRAYS}
    found = compared.groupBy("session_id").agg(
        F.greatest(F.lit(floor), F.coalesce(F.max(F.when(direction == "later", year + 1)), F.lit(floor))).alias("year_low"),
        F.least(F.lit(ceiling), F.coalesce(F.min(F.when(direction == "earlier", year - 1)), F.lit(ceiling))).alias("year_high"),
        F.max(F.when(direction == "same", year)).alias("year_exact"),
        *[x.alias(f"_{a}") for a, x in groups.items()],
    )
    flat = lambda a: F.array_join(F.array_distinct(F.flatten(F.col(f"_{a}.common_{a}"))), "|").alias(a)
    return found.select("session_id", "year_low", "year_high", "year_exact", *[flat(a) for a in ARRAYS])


def shared_groups(compared: DataFrame) -> DataFrame:
    """session_id, attempt, attribute, values of the groups that are not empty."""
    rows = compared.select("session_id", "attempt", F.explode(shared_values()).alias("x"))
    return rows.filter(F.size("x.values") > 0).select("session_id", "attempt", "x.attribute", F.array_join("x.values", "|").alias("shared"))


def puzzle_number(date: Column, epoch: str) -> Column:
    """G22."""
    return F.datediff(date, F.lit(epoch).cast("date")) + 1



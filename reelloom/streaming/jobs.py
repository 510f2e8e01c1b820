"""Streaming forms: resumable page ingest, attempt counts, session state, uniqueness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.pages import structure
from ..operators.replay import BASE, BONUS


def file_stream(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def page_sink(target: str):
    """Writes the rows of a batch of pages under the batch's number; the same batch again overwrites its own rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        structure(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return write


def ingest_pages(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The rows of new pages (page_id, html as text or as bytes), appended once; a run again after a crash repeats its last batch in place.

    A page that cannot be read becomes a row of section "error".
    """
    return pages.writeStream.foreachBatch(page_sink(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(attempts: DataFrame) -> DataFrame:
    """Outcomes so far, by status; for update or complete mode."""
    return attempts.groupBy("outcome").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def first_guesses(guesses: DataFrame, late: str = "1 day") -> DataFrame:
    """T4: the first row of each (session_id, pool_index) within the watermark; later than that is dropped."""
    return guesses.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "pool_index"])


SESSION_ROW = "session_id string, status string, used int, bonus_unlocked boolean, accepted string, closed boolean"

#: What is known of a session: status, used, bonus, the accepted works.
Folded = tuple[str, int, bool, tuple[int, ...]]
START: Folded = ("active", 0, False, ())


def advance(now: Folded, kind: str, pool_index: int, mystery_index: int, known: bool) -> Folded:
    """The session after one more event."""
    status, used, bonus, taken = now
    if kind == "unlock":
        bonus = bonus or (status != "won" and used >= BASE)
    elif kind == "guess" and status == "active" and used < BASE + BONUS * bonus and known and pool_index not in taken:
        taken, used = (*taken, pool_index), used + 1
        if pool_index == mystery_index:
            status = "won"
        elif bonus and used >= BASE + BONUS:
            status = "lost"
    return status, used, bonus, taken


def fold(events: list[tuple], now: Folded = START) -> Folded:
    """The session after events (order..., kind, pool_index, mystery_index, known) in their order."""
    for *_, kind, pool_index, mystery_index, known in sorted(events):
        now = advance(now, kind, pool_index, mystery_index, known)
    return now


class SessionFold(StatefulProcessor):
    """A session as a fold over its events in order of time and seq, whatever the order in which they arrive.

    Events that the watermark has passed are folded into a few values, ten accepted works at most;
    later ones wait in a buffer, since an earlier one may still come, and are folded on top for the
    row that a batch gives. All of it is one value, read and written once a batch, since every call of
    the state is a round trip. An event that comes again while it waits counts once; what comes after
    the watermark is dropped. When no event has come for `gap`, a timer gives the last row, closed,
    and all state of the session ends.
    """

    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = "array<struct<at:bigint,seq:bigint,kind:string,pool_index:int,mystery_index:int,known:boolean>>"
        self.held = handle.getValueState("held", f"status string, used int, bonus boolean, taken string, upto long, last long, waiting {waiting}")

    def read(self) -> tuple[Folded, int, int, dict[tuple, tuple]]:
        """What is folded, the time up to which it is, that of the last event, and the events that wait."""
        held = self.held.get()
        if held is None:
            return START, 0, 0, {}
        status, used, bonus, taken, upto, last, waiting = held
        return (status, used, bonus, tuple(map(int, taken.split(","))) if taken else ()), upto, last, {tuple(e[:2]): tuple(e[2:]) for e in waiting}

    def settle(self, now: Folded, waiting: dict[tuple, tuple], watermark: int) -> tuple[Folded, list[tuple]]:
        """Folds the waiting events that the watermark has passed; the others, for they still wait."""
        events = [(*key, *event) for key, event in waiting.items()]
        return fold([e for e in events if e[0] < watermark], now), [e for e in events if e[0] >= watermark]

    def row(self, key: tuple, now: Folded, closed: bool) -> Row:
        status, used, bonus, taken = now
        return Row(session_id=key[0], status=status, used=used, bonus_unlocked=bonus, accepted=",".join(map(str, taken)), closed=closed)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, upto, before, waiting = self.read()
        last = before
        for e in rows:
            if e.at >= upto:
                waiting[e.at, e.seq] = (e.kind, e.pool_index, e.mystery_index, e.known)
                last = max(last, e.at)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        now, later = self.settle(now, waiting, watermark)
        status, used, bonus, taken = now
        self.held.update((status, used, bonus, ",".join(map(str, taken)), max(upto, watermark), last, later))
        if last != before or before == 0:
            if before:
                self.handle.deleteTimer((before + self.gap) // 1000)
            self.handle.registerTimer((last + self.gap) // 1000)
        yield self.row(key, fold(later, now), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, _, _, waiting = self.read()
        now, later = self.settle(now, waiting, timerValues.getCurrentWatermarkInMs() * 1000)
        self.held.clear()
        yield self.row(key, fold(later, now), True)

    def close(self) -> None:
        pass


def session_states(events: DataFrame, late: str = "1 day", gap_days: float = 8) -> DataFrame:
    """The state of each session after each batch, and when it closes. events: session_id, seq, ts, kind, pool_index, mystery_index, known.

    seq must not fall as ts rises. Needs spark.sql.streaming.stateStore.providerClass set to the
    RocksDB provider when the stream starts.
    """
    timed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithState(SessionFold(int(gap_days * 86_400_000_000)), SESSION_ROW, "Update", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

"""Sessions that end by a change or by a gap, on streams with state and timers, and on tables.

A session of a user ends where the next event (by time, then id) is of another kind or comes more than `gap` later. On a
stream a user's events wait in state until the watermark has passed them, so that they are taken in order of time; a session
is emitted when its successor begins, or when the watermark has passed its last event by more than the gap. State holds a
user's events of the last `late` at most, and one open session.

Defined results: events later than the watermark allows are dropped by the stream; events without user, time or kind belong
to no session; repeated events count apiece; after a restart from the checkpoint a stream goes on where it was. A table gives
all sessions, the last ones too. Streams need the RocksDB state store (STATE_STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_OUT = "user_id long, part long, start long, end long, kind string, n long"


class _Sessions(StatefulProcessor):
    """Times are microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, id long, kind string")
        self.open = handle.getValueState("open", "part long, start long, last long, kind string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r.ts_us, r.event_id, r.event_type) for r in rows])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timers) -> Iterator[Row]:
        """Takes what the watermark has passed, emits sessions that are over, and asks to be called for the rest."""
        mark = timers.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in events if e[0] <= mark]
        now = tuple(self.open.get()) if self.open.exists() else None
        for ts, _, kind in ready:
            if now is None or kind != now[3] or ts > now[2] + self.gap:
                if now is not None and now[4]:
                    yield self._row(key, now)
                now = ((now[0] if now else 0) + 1, ts, ts, kind, 1)
            else:
                now = (now[0], now[1], ts, kind, now[4] + 1)
        if now is not None and now[4] and mark > now[2] + self.gap:
            yield self._row(key, now)
            now = (now[0], now[1], now[2], now[3], 0)  # only the number and the end are needed further on
        if ready:
            rest = events[len(ready) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if now is not None:
            self.open.update(now)
        due = [events[len(ready)][0]] if len(events) > len(ready) else []
        due += [now[2] + self.gap] if now is not None and now[4] else []
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    @staticmethod
    def _row(key, now) -> Row:
        return Row(user_id=key[0], part=now[0], start=now[1], end=now[2], kind=now[3], n=now[4])


def change_sessions(events: DataFrame, gap_seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """(user_id, part, start, end, kind, n): the sessions of events (event_id, user_id, ts, event_type), numbered by user."""
    known = events.where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    times = [F.timestamp_micros(c).alias(c) for c in ("start", "end")]
    if events.isStreaming:
        timed = known.withWatermark("ts", late).select("user_id", "ts", "event_id", "event_type", F.unix_micros("ts").alias("ts_us"))
        found = timed.groupBy("user_id").transformWithState(_Sessions(gap_seconds * 1_000_000), _OUT, "Append", "EventTime")
        return found.select("user_id", "part", *times, "kind", "n")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id", "event_type")
    timed = known.withColumn("us", F.unix_micros("ts"))
    fresh = (F.lag("event_type").over(order).isNull()) | (F.lag("event_type").over(order) != F.col("event_type")) | (F.col("us") > F.lag("us").over(order) + gap_seconds * 1_000_000)
    parts = timed.withColumn("fresh", fresh.cast("long")).withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = parts.groupBy("user_id", "part").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.first("event_type").alias("kind"), F.count("*").alias("n"))
    return found.select("user_id", "part", *times, "kind", "n")

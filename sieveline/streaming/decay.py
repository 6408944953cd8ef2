"""The activity fold as a stream with daily decay: event-time timers do what no event is there to do."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STATE = "total_scans long, scams long, reports long, recent long, risk long, active_days long, last_day date, decayed date, late long, timer long"
OUTPUT = "user_id long, total_scans long, scams long, reports long, recent long, risk long, active_days long, late long"
#: State with timers is kept by this provider alone.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = date(1970, 1, 1)


def _midnight(day: date) -> int:
    """The first millisecond of a day, UTC."""
    return (day - _EPOCH).days * 86_400_000


class Activity:
    """One user's counters. `decayed`: the day up to whose beginning daily decays are done."""

    def __init__(self, saved: tuple | None):
        self.total, self.scams, self.reports, self.recent, self.risk, self.days, self.last, self.decayed, self.late, self.timer = saved or (0, 0, 0, 0, 0, 1, None, None, 0, 0)

    def saved(self) -> tuple:
        return self.total, self.scams, self.reports, self.recent, self.risk, self.days, self.last, self.decayed, self.late, self.timer

    def decay_to(self, day: date) -> None:
        """The decays at the ends of all days before `day` that aren't done yet; they stop by themselves when nothing is left."""
        for _ in range((day - self.decayed).days):
            if not self.recent and not self.risk:
                break
            self.recent, self.risk = self.recent * 9 // 10, max(0, self.risk - 1)
        self.decayed = max(day, self.decayed)

    def add_day(self, day: date, n: dict[str, int], first: str | None) -> None:
        """What a day's events do: within a day, only how many there are of each kind, and which scan or opening came first, matters."""
        if self.decayed is None:
            self.decayed = day
        self.decay_to(day)
        if day < self.decayed:
            self.late += sum(n.values())
        hits = n.get("scam", 0)
        self.total += hits + n.get("safe", 0)
        self.scams += hits
        self.reports += n.get("report", 0)
        self.recent += hits
        self.risk = min(100, self.risk + 5 * hits) if hits else self.risk
        if first is not None:
            self.days += first == "open" and self.last is not None and self.last < day
            self.last = day if self.last is None else max(self.last, day)


class DailyFold(StatefulProcessor):
    """State of one user. A batch's events are counted by day as they come, so a user with very many has a row a day in memory.

    As long as there is something to decay, a timer stands at the end of the day; when the watermark passes it, all days
    that are over by then are done at once. Events of a day that is done already are counted as late and added all the
    same; those behind the watermark are dropped by Spark, which reports their number with the query's progress.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("activity", STATE)

    def _put(self, key: tuple, own: Activity) -> Iterator[Row]:
        if (own.recent or own.risk) and not own.timer:
            own.timer = _midnight(own.decayed + timedelta(days=1))
            self.handle.registerTimer(own.timer)
        self.state.update(own.saved())
        yield Row(user_id=key[0], total_scans=own.total, scams=own.scams, reports=own.reports, recent=own.recent, risk=own.risk, active_days=own.days, late=own.late)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        days: dict[date, tuple[dict[str, int], list]] = {}
        for r in rows:
            n, first = days.setdefault(r.ts.date(), ({}, []))
            n[r.kind] = n.get(r.kind, 0) + 1
            if r.kind in ("scam", "safe", "open") and (not first or (r.ts, r.event_id) < first[0][:2]):
                first[:] = [(r.ts, r.event_id, r.kind)]
        own = Activity(tuple(self.state.get()) if self.state.exists() else None)
        for day in sorted(days):
            n, first = days[day]
            own.add_day(day, n, first[0][2] if first else None)
        yield from self._put(key, own)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        own = Activity(tuple(self.state.get()))
        own.decay_to(_EPOCH + timedelta(milliseconds=max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())))
        own.timer = 0
        yield from self._put(key, own)

    def close(self) -> None:
        pass


def use_timers(spark: SparkSession) -> None:
    """Names the state store that timers need; for a session that runs such a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def decaying_activity(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """A streaming log (user_id, ts, event_id, kind) to each user's counters, after each batch and after each day that ends.

    Timestamps are UTC. Once the stream has come to an end, a user's recent scams and risk are those of the batch fold
    with decays through the day that the watermark has reached.
    """
    timed = log.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "kind").withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithState(DailyFold(), OUTPUT, "update", "EventTime")

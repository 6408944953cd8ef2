"""The activity fold as a stream: the same counters as the batch fold, one row of state per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "total_scans long, scams long, reports long, recent long, risk long, active_days long, last_day date"
OUTPUT = "user_id long, total_scans long, scams long, reports long, recent long, risk long, active_days long"


def step(state: tuple, kind: str, day) -> tuple:
    """One event on a user's state."""
    total, scams, reports, recent, risk, days, last = state
    if kind == "decay":
        return total, scams, reports, recent * 9 // 10, max(0, risk - 1), days, last
    if kind == "report":
        return total, scams, reports + 1, recent, risk, days, last
    if kind == "open":
        return total, scams, reports, recent, risk, days + (last is not None and last != day), day
    hit = int(kind == "scam")
    return total + 1, scams + hit, reports, recent + hit, min(100, risk + 5) if hit else risk, days, day


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    own = tuple(state.get) if state.exists else (0, 0, 0, 0, 0, 1, None)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for kind, ts in zip(rows.kind, rows.ts, strict=True):
        own = step(own, kind, ts.date())
    state.update(own)
    yield pd.DataFrame([(key[0], *own[:6])], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def activity_stream(log: DataFrame) -> DataFrame:
    """A streaming log (user_id, ts, event_id, kind) to each user's counters after each batch.

    Within a batch a user's events are taken in order of time; batches are taken as they come, so the log is expected
    in order of time across batches (the source's own order), as the fold isn't commutative.
    """
    return log.groupBy("user_id").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, kind, n) by event time, events deduplicated by id within the watermark."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))

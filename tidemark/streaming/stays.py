"""Stays of a key in one state, from rows that come out of order: a stay ends when the state changes, or by a timer when the key has not been seen for some days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
#: Timers are set to the days that hold their times, so a key has a few of them, not one a row.
OPEN = "status string, first long, last long"


class Stays(StatefulProcessor):
    """Rows wait in a list until the watermark has passed their day, so that late ones find their place; then they join or end the open stay in their order."""

    def __init__(self, key: str, kind: str, absent: int) -> None:
        self.key, self.kind, self.absent = key, kind, absent * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, status string")
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(at), None if pd.isna(s) else s) for part in rows for at, s in zip(part["seen_ms"], part["seen_status"])]
        self.waiting.appendList(came)
        for day in {at // DAY for at, _ in came}:
            self.handle.registerTimer((day + 1) * DAY)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [(at, s) for at, s in self.waiting.get()]
        due = sorted((x for x in waiting if x[0] < now), key=lambda x: (x[0], x[1] or ""))
        if len(due) < len(waiting):
            self.waiting.put([x for x in waiting if x[0] >= now])
        elif waiting:
            self.waiting.clear()
        held, done = self.open.get() if self.open.exists() else None, []
        for at, status in due:
            if held and held[0] == status and at - held[2] <= self.absent:
                held = (status, held[1], max(held[2], at))
            else:
                done += [held] if held else []
                held = (status, at, at)
        if held and now - held[2] > self.absent:
            done, held = [*done, held], None
        if held:
            self.open.update(held)
            self.handle.registerTimer((held[2] + self.absent) // DAY * DAY + DAY)
        elif self.open.exists():
            self.open.clear()
        yield self._rows(key, done)

    def _rows(self, key: tuple, done: list[tuple]) -> pd.DataFrame:
        times = [pd.to_datetime([d[k] for d in done], unit="ms") for k in (1, 2)]
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(done), dtype="object" if not done else None), "status": pd.Series([d[0] for d in done], dtype="object"), "first_seen": times[0], "last_seen": times[1]})

    def close(self) -> None:
        pass


def stays_by_key(stream: DataFrame, key: str, status: str, at: str, absent: int, wait: str = "1 day") -> DataFrame:
    """key, status, first_seen, last_seen of every stay that has ended (append): a key in one status, never unseen for over `absent` days.

    Rows may come `wait` late and in any order; what is open stays in state until its key is seen in another status, or its timer finds that it has not been seen for `absent` days.
    Rows of a null key are one key; rows of a null time are left out.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, wait)
    rows = rows.select(key, at, F.unix_millis(at).alias("seen_ms"), F.col(status).cast("string").alias("seen_status"))
    out = f"{key} {kind}, status string, first_seen timestamp, last_seen timestamp"
    return rows.groupBy(key).transformWithStateInPandas(Stays(key, kind, absent), out, "Append", "EventTime")

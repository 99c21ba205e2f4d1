"""Reservations that expire: a publication that was begun and not finished in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "story_id string, state string, at timestamp"


class _Reservation(StatefulProcessor):
    """One story: the start of its open reservation, and a timer for its end."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names are Spark's
        events = pd.concat(list(rows)).sort_values(["at", "status"])
        out = []
        for at, status in zip(events["at"], events["status"], strict=True):
            ms = int(at.timestamp() * 1000)
            open_at = self.started.get()[0] if self.started.exists() else None
            if open_at is not None and ms >= open_at + self.wait:
                # The end came before this event did.
                self._close(open_at)
                out.append((key[0], "expired", open_at + self.wait))
                open_at = None
            if status == "publishing" and open_at is None:
                self.started.update((ms,))
                self.handle.registerTimer(ms + self.wait)
            elif status != "publishing" and open_at is not None:
                self._close(open_at)
                out.append((key[0], "finished", ms))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.started.exists() and expiredTimerInfo.getExpiryTimeInMs() == self.started.get()[0] + self.wait:
            out.append((key[0], "expired", expiredTimerInfo.getExpiryTimeInMs()))
            self.started.clear()
        yield self._rows(out)

    def _close(self, open_at: int) -> None:
        self.handle.deleteTimer(open_at + self.wait)
        self.started.clear()

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["story_id", "state", "at"])
        return frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))

    def close(self) -> None:
        pass


def expiring(events: DataFrame, minutes: int = 30, late: str = "1 minute") -> DataFrame:
    """(story_id, state, at): finished when a reservation (story_id, status, at) is followed in time by another status, expired when the watermark passes its end first."""
    rows = events.selectExpr("cast(story_id as string) story_id", "status", "at").withWatermark("at", late)
    return rows.groupBy("story_id").transformWithStateInPandas(_Reservation(max(5, minutes)), outputStructType=SCHEMA, outputMode="append", timeMode="EventTime")

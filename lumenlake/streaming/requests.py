"""One open request per owner: a request while one is open is answered with that one, until it ends or expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import as_event_time

_ANSWER = "user_id bigint, event_id bigint, job_id bigint, reused boolean"


class _OpenRequests(StatefulProcessor):
    """The open request of an owner: its id and the microsecond at which it expires.

    Rows are judged by their own times; the timer only drops a state that no later row can meet."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "job_id bigint, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, out = (self.open.get() if self.open.exists() else None), []
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            if now is not None and r["at"] > now[1]:
                now = None
            if r["ends"]:
                now = None
                continue
            reused = now is not None
            if now is None:
                now = (r["event_id"], r["at"] + self.micros)
            out.append(Row(user_id=key[0], event_id=r["event_id"], job_id=now[0], reused=reused))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            self.handle.registerTimer(now[1] // 1000 + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        return iter(())


def open_requests(events: DataFrame, time: str, minutes: int, late: str = "0 seconds") -> DataFrame:
    """(user_id, event_id, job_id, reused) per request of a stream (user_id, event_id, `time`, ends): the id of the
    request that is open then, itself if none is.

    A row with `ends` closes the owner's open request and has no answer; one is open for `minutes`, the last instant
    included.  State is one row per owner with an open request, dropped once the watermark is past its end."""
    timed = as_event_time(events, time).withWatermark(time, late)
    rows = timed.select("user_id", "event_id", time, F.unix_micros(time).alias("at"), "ends")
    return rows.groupBy("user_id").transformWithState(_OpenRequests(minutes * 60_000_000), _ANSWER, "append", "eventTime")

"""Follow-ups of cases as a stream: windows that a timer closes once the watermark is past them."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "at long, event_id long, event_type string"
OUT = "case long, opened_id long, opened_at long, follow_ups long, first_mitigation long, closed_at long, censored boolean"
DAY = 86_400_000_000


class Cases(StatefulProcessor):
    """Keeps a case's events that an open window may need, and tells a window once the watermark is past its end. Times
    are microseconds."""

    def __init__(self, opens: str, mitigates: str, cutoff: int, days: int):
        self.opens, self.mitigates, self.cutoff, self.span = opens, mitigates, cutoff, days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)

    def _end(self, opened: int) -> int:
        return min(opened + self.span, self.cutoff)

    @staticmethod
    def _ms(t: int) -> int:
        """The first millisecond behind a time."""
        return t // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, r.event_id, r.event_type) for r in rows]
        self.events.appendList(new)
        for at, _, kind in new:
            if kind == self.opens:
                self.handle.registerTimer(self._ms(self._end(at)))
        if not any(kind == self.opens for *_, kind in new):
            self._prune(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(map(tuple, self.events.get()))
        starts = [i for i, e in enumerate(held) if e[2] == self.opens]
        out = []
        for i, j in zip(starts, [*starts[1:], len(held)], strict=False):
            opened = held[i][0]
            end = self._end(opened)
            # the first timer that a watermark sets off tells all windows that are over, and their events go
            if self._ms(end) <= now:
                inside = [e for e in held[i + 1 : j] if e[0] <= end]
                cured = next((e[1] for e in inside if e[2] == self.mitigates), None)
                out.append(Row(case=key[0], opened_id=held[i][1], opened_at=opened, follow_ups=len(inside), first_mitigation=cured, closed_at=end, censored=end < opened + self.span))
        self._prune(now)
        return iter(out)

    def _prune(self, watermark: int) -> None:
        """Events that no window can need any more go: those before the first opening whose window is still open, or which
        may still come."""
        held = sorted(map(tuple, self.events.get()))
        first = next((e[0] for e in held if e[2] == self.opens and self._ms(self._end(e[0])) > watermark), None)
        kept = [e for e in held if (first is not None and e[0] >= first) or self._ms(e[0]) > watermark]
        if len(kept) < len(held):
            self.events.put(kept) if kept else self.events.clear()

    def close(self) -> None:
        pass


def trace_stream(events: DataFrame, opens: str, mitigates: str, cutoff: datetime.datetime, days: int, delay: str, case_col: str = "user_id") -> DataFrame:
    """lineage.trace_cases over a stream of (case, ts, event_id, event_type): the rows of windows that are over, each once.

    A window is told when the watermark, the latest time seen less `delay`, is past its end, which is `days` after its
    opening or the cutoff; events that come in any order within the delay count as in the batch. Later ones are dropped,
    which Spark counts in the query's progress. Windows that are open when the stream ends stay in its state, and are
    told by the run that brings later events. State holds a case's events from its first open window on.

    Null times take no part; a null case is one. The state store has to be that of RocksDB. Rows are those of OUT with
    times as timestamps; cutoff is a time of UTC without a zone.
    """
    at = F.col("ts").cast("timestamp")
    rows = events.where(F.col("ts").isNotNull()).select(F.col(case_col).cast("long").alias("case"), at.alias("ts"), F.unix_micros(at).alias("at"), F.col("event_id").cast("long").alias("event_id"), "event_type")
    last = (cutoff - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    found = rows.withWatermark("ts", delay).groupBy("case").transformWithState(Cases(opens, mitigates, last, days), OUT, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("opened_at", "closed_at")})

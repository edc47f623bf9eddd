"""Sessions of a stream, given out once they have settled.

A session has settled when event time has gone six hours beyond its start: until then, late rows still count for it.
State is kept by session until its timer fires: sums, and the ids and entrants that were seen, in a state store on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session string, started timestamp, rows long, entrants long, first timestamp, last timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settled(StatefulProcessor):
    """Adds up a session's rows and gives them out when its timer fires."""

    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "started long, rows long, first long, last long")
        self.entrants = handle.getMapState("entrants", "entrant string", "seen boolean")
        self.seen = handle.getMapState("seen", "id string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.sums.get() if self.sums.exists() else None
        started, n, first, last = had if had else (None, 0, None, None)
        for part in rows:
            for r in part.itertuples(index=False):
                if self.seen.containsKey((r.id,)):
                    continue  # delivered before
                self.seen.updateValue((r.id,), (True,))
                self.entrants.updateValue((r.entrant,), (True,))
                at = int(r.at_ms)
                started = int(r.started_ms) if started is None else min(started, int(r.started_ms))
                n, first, last = n + 1, at if first is None else min(first, at), at if last is None else max(last, at)
        if started is not None:
            self.sums.update((started, n, first, last))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # a session that is over already is given out when the watermark next moves
            self.handle.registerTimer(max(started + self.settle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, n, first, last = self.sums.get()
        entrants = sum(1 for _ in self.entrants.keys())
        self.sums.clear()
        self.entrants.clear()
        self.seen.clear()
        when = lambda ms: pd.Timestamp(ms, unit="ms")
        yield pd.DataFrame({"session": [key[0]], "started": [when(started)], "rows": [n], "entrants": [entrants], "first": [when(first)], "last": [when(last)]})

    def close(self) -> None:
        pass


def settled_sessions(rows: DataFrame, session: str = "session", start: str = "start", time: str = "ts", entrant: str = "driver", row_id: str = "event_id", settle: str = "6 hours", settle_ms: int = 6 * 3_600_000) -> DataFrame:
    """session, started, rows, entrants, first, last of each session, once its settle time has passed.

    rows: a stream with the session's name and start, the row's own time, its entrant and an id. Repeated ids count once.
    A row that comes after its session was given out is dropped by the watermark, which trails the latest row by the
    settle time. Rows without a session, start, time or id take no part.
    """
    known = rows.filter(F.col(session).isNotNull() & F.col(start).isNotNull() & F.col(time).isNotNull() & F.col(row_id).isNotNull())
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    x = known.select(
        F.col(session).cast("string").alias("session"), F.col(time).cast("timestamp").alias("at"), ms(time).alias("at_ms"), ms(start).alias("started_ms"),
        F.coalesce(F.col(entrant).cast("string"), F.lit("")).alias("entrant"), F.col(row_id).cast("string").alias("id"),
    ).withWatermark("at", settle)
    return x.groupBy("session").transformWithStateInPandas(Settled(settle_ms), OUT, "Append", "EventTime")

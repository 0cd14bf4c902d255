"""Admission of requests under a rolling token budget, as a stream whose later decisions depend on earlier ones.

A tenant's requests are taken in the order of their times.  One that fits into what the last `seconds` have left, or that
finds nothing booked, is booked at once; one that doesn't waits until half a second after the oldest booking has left the
window, and is looked at again; those behind it wait for it.

State, for each tenant: the bookings inside the window, the time of the last one, and the requests that the watermark
hasn't passed.  Requests that come late, but not later than the watermark allows, are put in their place before anything
is decided; a request that is delivered again is known by its id while it is held, and is behind the watermark after
that, where Spark drops it.  Timers at the requests' own times start the decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECIDED = "tenant string, id string, asked_us long, booked_us long, tokens long"
SECOND = 1_000_000


class Budget:
    """Bookings (time, tokens) of one tenant, in microseconds."""

    def __init__(self, limit: int, window: int, booked: list[tuple[int, int]] | None = None, last: int | None = None) -> None:
        self.limit, self.window, self.booked, self.last = limit, window, booked or [], last

    def book(self, asked: int, tokens: int) -> int:
        """When a request is booked."""
        now = asked if self.last is None else max(asked, self.last)
        self.booked = [b for b in self.booked if now - b[0] < self.window]
        while self.booked and sum(n for _, n in self.booked) + tokens > self.limit:
            now = max(now + SECOND // 2, self.booked[0][0] + self.window + SECOND // 2)
            self.booked = [b for b in self.booked if now - b[0] < self.window]
        self.booked.append((now, tokens))
        self.last = now
        return now


class Admission(StatefulProcessor):
    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id string", "asked_us long, tokens long")
        self.booked = handle.getListState("booked", "at long, tokens long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for name, asked, tokens in zip(frame["id"], frame["asked_us"], frame["tokens"], strict=True):
                if not self.waiting.containsKey((name,)):
                    self.waiting.updateValue((name,), (int(asked), int(tokens)))
                    self.handle.registerTimer(-(-int(asked) // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((asked, name, tokens) for (name,), (asked, tokens) in self.waiting.iterator() if asked <= passed)
        if not ready:
            return
        last = self.last.get()
        budget = Budget(self.limit, self.window, [tuple(b) for b in self.booked.get()], last[0] if last else None)
        out = []
        for asked, name, tokens in ready:
            out.append((key[0], name, asked, budget.book(asked, tokens), tokens))
            self.waiting.removeKey((name,))
        self.booked.put(budget.booked)
        self.last.update((budget.last,))
        yield pd.DataFrame(out, columns=["tenant", "id", "asked_us", "booked_us", "tokens"])


def admit(requests: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """A stream of requests (tenant, id, ts, tokens) -> decisions (tenant, id, asked_us, booked_us, tokens), once each.  Needs
    the state store on disk: spark.sql.streaming.stateStore.providerClass is set for the session."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.where("tenant is not null and id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select(F.col("tenant").cast("string").alias("tenant"), F.col("id").cast("string").alias("id"), "ts", F.unix_micros("ts").alias("asked_us"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    return rows.groupBy("tenant").transformWithStateInPandas(Admission(limit, seconds), DECIDED, "Append", "EventTime")

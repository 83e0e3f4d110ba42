"""Open sessions of each curve as keyed state with event-time timers and expiry.

A session is a stretch of a curve whose samples lie at most `gap` apart. Its
state is first and last time, count and sum, so it does not grow with the
samples; samples may come in any order within the watermark and join sessions
together. When the watermark passes the end of a session by the gap, a timer
emits it and takes it out of the state; a curve without open sessions has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "curve_id bigint, start timestamp, end timestamp, n bigint, total double"
STATE = "first bigint, last bigint, n bigint, total double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (first, last, n, total) in order, those at most gap apart joined; times in microseconds."""
    out: list[tuple] = []
    for a, z, n, total in sorted(sessions):
        if out and a - out[-1][1] <= gap:
            b, y, m, t = out[-1]
            out[-1] = (b, max(y, z), m + n, t + total)
        else:
            out.append((a, z, n, total))
    return out


class OpenSessions(StatefulProcessor):
    """gap in microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", STATE)

    def _held(self) -> list[tuple]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def _keep(self, sessions: list[tuple]) -> None:
        if sessions:
            self.open.put(sessions)
            # in milliseconds, rounded up: the timer comes once the session can get no more samples
            self.handle.registerTimer(-(-(min(s[1] for s in sessions) + self.gap + 1) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            new += [(int(t), int(t), 1, float(v)) for t, v in zip(us, pdf["value"])]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(merged(self._held() + new, self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        done = [s for s in held if s[1] + self.gap < now]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep([s for s in held if s[1] + self.gap >= now])
        at = lambda k: pd.to_datetime([s[k] for s in done], unit="us")
        if done:
            yield pd.DataFrame({"curve_id": [key[0]] * len(done), "start": at(0), "end": at(1), "n": [s[2] for s in done], "total": [round(s[3], 6) for s in done]})

    def close(self) -> None:
        pass


def closed_sessions(curves: DataFrame, gap_hours: float = 12.0, late: str = "1 hour") -> DataFrame:
    """Sessions of each curve (curve_id, ts, value): curve_id, start, end, n and total.

    A batch gives all sessions; a stream gives each once, when the watermark
    has passed its end by the gap. Samples with a null curve, time or value are
    left out; on a stream, so are those behind the watermark. Streams need the
    session's state store to be PROVIDER.
    """
    gap = int(gap_hours * 3.6e9)
    rows = curves.where("curve_id is not null and ts is not null and value is not null").select(F.col("curve_id").cast("bigint").alias("curve_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    if curves.isStreaming:
        return rows.withWatermark("ts", late).groupBy("curve_id").transformWithStateInPandas(OpenSessions(gap), OUT, "append", "eventTime")
    w = Window.partitionBy("curve_id").orderBy("ts")
    us = F.unix_micros("ts")
    new = F.when(us - F.lag(us).over(w) > gap, 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("curve_id", "_s").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).drop("_s")


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

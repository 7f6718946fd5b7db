"""Event states on a stream: one keyed state an event, timers for its publication and its close, late rows set aside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsengine.sources.shared import checkpointed

MINUTE, DAY = 60_000, 86_400_000
PUBLISH_MS, QUIET_MS = 5 * MINUTE, 7 * DAY
CHANGE = "event_id string, at timestamp, old_state string, state string, reason string, articles long, t0 timestamp, t_last timestamp"
STATE = "state string, t0 long, t_last long, publish_at long, articles long"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class EventLifecycle(StatefulProcessor):
    """The life of one event: pending with its first link, published five minutes on, closed after seven quiet days.

    Its state is five values, and two timers stand at most. A closed event
    leaves no state: a link after that begins a new life, as a new event
    would. Links to an existing event move ``t_last``; a link older than what
    was seen moves nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("event", STATE)

    def change(self, key: str, at: int, old: str | None, now: tuple, reason: str) -> list:
        ts = lambda ms: pd.Timestamp(ms, unit="ms")
        return [key, ts(at), old, now[0], reason, now[4], ts(now[1]), ts(now[2])]

    def out(self, rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = []
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            ms = int(row.ts.timestamp() * 1000)
            if not self.held.exists():
                now = ("PENDING_PUBLISH", ms, ms, ms + PUBLISH_MS, 1)
                self.handle.registerTimer(now[3])
                self.handle.registerTimer(ms + QUIET_MS)
                told.append(self.change(str(key[0]), ms, "DETECTED", now, "FIRST_LINK"))
            else:
                state, t0, t_last, publish_at, articles = self.held.get()
                moved = max(t_last, ms) if row.link_action == "LINKED_EXISTING" else t_last
                if moved != t_last:
                    self.handle.deleteTimer(t_last + QUIET_MS)
                    self.handle.registerTimer(moved + QUIET_MS)
                now = (state, t0, moved, publish_at, articles + 1)
            self.held.update(now)
        yield self.out(told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, at = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.held.exists():
            state, t0, t_last, publish_at, articles = self.held.get()
            if at == publish_at and state == "PENDING_PUBLISH":
                now = ("PUBLISHED", t0, t_last, publish_at, articles)
                self.held.update(now)
                told.append(self.change(str(key[0]), at, state, now, "DUE"))
            if at >= t_last + QUIET_MS:
                told.append(self.change(str(key[0]), at, state, ("CLOSED", t0, t_last, publish_at, articles), "INACTIVITY_7D"))
                self.held.clear()
        yield self.out(told)

    def close(self) -> None:
        pass


def event_changes(linked: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Changes of state (CHANGE) of the events of a stream (event_id, link_action, ts).

    Time is that of the rows: the watermark, ``delay`` behind the newest one,
    sets the timers off. A batch reads the states of the events it touches and
    those whose timers are due, whatever went before. The session's state
    store has to be the one in ``ROCKS``, which keeps states out of memory.
    """
    source = linked.withWatermark("ts", delay)
    return source.groupBy("event_id").transformWithStateInPandas(statefulProcessor=EventLifecycle(), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def without_late(sink: Callable[[DataFrame, int], None], folder: str, delay_ms: int, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands rows on to ``sink`` and sets late ones aside in ``folder``/late.

    A row is late if its time is more than ``delay_ms`` behind the newest time
    of the batches before: it is behind the watermark that Spark would hold,
    where it would be dropped without a trace. Rows without a time are late.
    Each batch leaves the newest time so far as one row under its number, so a
    batch that runs again splits alike and its late rows replace themselves.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = checkpointed(batch)
        before = None
        if batch_id > 0 and exists(spark, f"{folder}/newest/{batch_id - 1}"):
            before = spark.read.parquet(f"{folder}/newest/{batch_id - 1}").first()["newest"]
        late: Column = F.col(ts).isNull()
        if before is not None:
            late = late | (F.unix_millis(ts) < before - delay_ms)
        rows.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        sink(rows.where(~late), batch_id)
        newest = rows.agg(F.greatest(F.max(F.unix_millis(ts)), F.lit(before).cast("long")).alias("newest"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/{batch_id}")

    return run

"""Streams that speak when time passes, though no row comes: heartbeats of active sessions and alarms of quiet ones.

Both follow each session's rows by event time. What is due between two rows of a
session is emitted when the later one comes; what is due after its last one when
the watermark gets there. A row older than one that was taken before is taken at
that one's time: what was emitted is not taken back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What rows say of their session.
START, RESET, STOP = "START", "RESET", "STOP"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers_allowed(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which timers ask for, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class DueTimes(StatefulProcessor):
    """Keeps (since, due, last) of a session: where its wait began, when it next speaks, and the last time seen."""

    def __init__(self, wait_s: int, repeats: bool):
        self.wait_s, self.repeats = wait_s, repeats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", "since long, due long, last long")

    def _passed(self, due: int, until: int) -> tuple[list[int], int]:
        """What is due up to ``until``, and what is due next; -1: nothing."""
        out = []
        while 0 <= due <= until:
            out.append(due)
            due = due + self.wait_s if self.repeats else -1
        return out, due

    def _keep(self, since: int, due: int, last: int, timer: int) -> None:
        """Update the state, and the timer if it changes; ``timer`` is when the one that is there is due, -1: none."""
        self.state.update((since, due, last))
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer * 1000)
            if due >= 0:
                self.handle.registerTimer(due * 1000)

    def _rows(self, key: tuple, found: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]] * len(found), "since": [s for s, _ in found], "at": [t for _, t in found]}).astype("int64")

    def handleInputRows(self, key, rows, timerValues):
        since, due, last = self.state.get() or (-1, -1, -1)
        timer, found = due, []
        for at, _, says in sorted((int(a), int(o), s) for f in rows for a, o, s in zip(f["at"], f["place"], f["says"])):
            last = max(last, at)
            passed, due = self._passed(due, last)
            found += [(since, t) for t in passed]
            if says == START or (says == RESET and since >= 0 and not self.repeats):
                since, due = last, last + self.wait_s
            elif says == STOP:
                since, due = -1, -1
        self._keep(since, due, last, timer)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        since, due, last = self.state.get()
        timer = due
        passed, due = self._passed(due, timerValues.getCurrentWatermarkInMs() // 1000)
        self._keep(since, due, last, timer)
        yield self._rows(key, [(since, t) for t in passed])

    def close(self) -> None:
        pass


def _due(stream: DataFrame, delay: str, processor: DueTimes) -> DataFrame:
    timed = stream.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType="session_id long, since long, at long", outputMode="Append", timeMode="EventTime")


def quiet_alarms(stream: DataFrame, quiet_s: int, delay: str = "0 seconds") -> DataFrame:
    """(session_id, since, at): an active session that nothing has reset for ``quiet_s`` seconds; once for each start or reset.

    Rows: session_id, at (whole seconds), place (order among rows of one
    second), says. A session is active from START to STOP; a row at the very
    second of an alarm comes too late for it.
    """
    return _due(stream, delay, DueTimes(quiet_s, False))


def heartbeats(stream: DataFrame, every_s: int, delay: str = "0 seconds") -> DataFrame:
    """(session_id, since, at): every ``every_s`` seconds that an active session has gone on; rows as for :func:`quiet_alarms`."""
    return _due(stream, delay, DueTimes(every_s, True))


class OpenTriggers(StatefulProcessor):
    """Keeps a session's open trigger (opened, rank, trigger, reasons, n, from_event) until it has been open for a while."""

    def __init__(self, hold_s: int, ranks: dict[str, int]):
        self.hold_s, self.ranks = hold_s, ranks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "opened long, rank long, trigger string, reasons string, n long, from_event boolean")

    def _merged(self, now: tuple | None, at: int, trigger: str, from_event: bool) -> tuple:
        rank = self.ranks[trigger]
        if now is None:
            return at, rank, trigger, trigger, 1, from_event
        opened, best, lead, reasons, n, sticks = now
        reasons = reasons if trigger in reasons.split(",") else f"{reasons},{trigger}"
        return opened, min(best, rank), trigger if rank < best else lead, reasons, n + 1, sticks or from_event

    def _rows(self, key: tuple, closed: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], opened, trigger, reasons, n, "EVENT" if sticks else "HEARTBEAT") for opened, _, trigger, reasons, n, sticks in closed]
        return pd.DataFrame(rows, columns=["session_id", "opened", "trigger", "reasons", "n", "source"]).astype({"session_id": "int64", "opened": "int64", "n": "int64"})

    def handleInputRows(self, key, rows, timerValues):
        kept, closed = self.state.get(), []
        now = tuple(kept) if kept else None
        timer = now and now[0]
        for at, _, trigger, from_event in sorted((int(a), int(o), t, bool(e)) for f in rows for a, o, t, e in zip(f["at"], f["place"], f["trigger"], f["from_event"])):
            if now is not None and at >= now[0] + self.hold_s:
                closed.append(now)
                now = None
            now = self._merged(now, at, trigger, from_event)
        self.state.update(now)
        if now[0] != timer:
            if timer is not None:
                self.handle.deleteTimer((timer + self.hold_s) * 1000)
            self.handle.registerTimer((now[0] + self.hold_s) * 1000)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept = self.state.get()
        closed = [tuple(kept)] if kept else []
        self.state.clear()
        yield self._rows(key, closed)

    def close(self) -> None:
        pass


def coalesced(stream: DataFrame, hold_s: int, ranks: dict[str, int], delay: str = "0 seconds") -> DataFrame:
    """(session_id, opened, trigger, reasons, n, source): triggers of a session that come while one is open join it.

    Rows: session_id, at, place, trigger, from_event. The trigger of least rank
    leads, reasons keep the order in which they came first, and an event's
    source sticks. An open trigger is handed on ``hold_s`` seconds after it
    opened, by a row or by the watermark. Triggers without a rank are left out.
    """
    timed = stream.filter(F.col("trigger").isin(*ranks)).withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay)
    schema = "session_id long, opened long, trigger string, reasons string, n long, source string"
    return timed.groupBy("session_id").transformWithStateInPandas(statefulProcessor=OpenTriggers(hold_s, ranks), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def recomputed(path: str, rows_path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for late rows: what they touch is computed anew from all rows of its keys.

    Rows are kept below ``rows_path`` and results below ``path``, both by
    version of the batch, so a repeated batch replaces its own version alone. A
    version of results holds the touched keys; :func:`latest_results` reads the
    last one of each key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{rows_path}/version={batch_id}")
        every = spark.read.schema(batch.schema).parquet(*[f"{rows_path}/version={i}" for i in range(batch_id + 1)])
        touched = spark.read.schema(batch.schema).parquet(f"{rows_path}/version={batch_id}").select(*keys).distinct()
        compute(every.join(touched, keys, "left_semi")).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def latest_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The results of the last version that holds their keys."""
    every = spark.read.parquet(path)
    last = every.groupBy(*keys).agg(F.max("version").alias("version"))
    return every.join(last, [*keys, "version"], "left_semi").drop("version")

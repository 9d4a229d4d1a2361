"""The trigger of operators.sessions on a stream: state for each channel, and a timer for silence.

Each channel keeps a few counts, the sums of the running session and the last `before` samples: state is
bounded whatever the stream is. Samples of a micro-batch are gone through in order of their number, so
that results do not depend on how samples fall into micro-batches; a sample that comes again, with a
number seen before, changes nothing. When the watermark has passed the last sample by `silence` seconds, a timer ends the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidejoin.operators.sessions import SCHEMA, Trigger
from tidejoin.sources.shared import own_folder
from tidejoin.streaming.join import file_stream, in_time_slices, run_available
from tidejoin.streaming.stores import ROCKSDB, settings

#: number and time (microseconds) of the last sample; samples in a row above and below; the running session's trigger (-1: none), first, last,
#: captured samples and their sum; samples since the trigger; the number after which samples may come ahead of a trigger.
STATE = "number long, at long, above long, below long, trigger long, first long, last long, n long, total double, since long, closed long"


class TriggerProcessor(StatefulProcessor):
    """Sessions of one channel."""

    def __init__(self, trigger: Trigger):
        self.spec = trigger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)
        self.ring = handle.getListState("ring", "number long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["number", "ts", "value"]] for r in rows]).drop_duplicates("number").sort_values("number")
        machine = Machine(self.spec, self.run.get(), list(self.ring.get()))
        found = []
        micros = new["ts"].astype("datetime64[us]").astype("int64")
        for number, at, value in zip(new["number"].tolist(), micros.tolist(), new["value"].tolist(), strict=True):
            found += machine.add(number, at, value)
        self._keep(machine)
        if found:
            yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = Machine(self.spec, self.run.get(), list(self.ring.get()))
        if found := machine.silence():
            self._keep(machine)
            yield self._frame(key, found)

    def _keep(self, machine: Machine) -> None:
        self.run.update(machine.state())
        if machine.ring:
            self.ring.put(machine.ring)
        else:
            self.ring.clear()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if machine.at is not None:
            self.handle.registerTimer(machine.at // 1000 + self.spec.silence * 1000 + 1)

    def _frame(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *f) for f in found], columns=["channel", "trigger", "first", "last", "n", "total"])

    def close(self) -> None:
        pass


class Machine:
    """The trigger's state for one channel, sample by sample."""

    def __init__(self, spec: Trigger, state: tuple | None, ring: list[tuple]):
        self.spec, self.ring = spec, [tuple(x) for x in ring]
        self.number, self.at, self.above, self.below, self.trigger, self.first, self.last, self.n, self.total, self.since, self.closed = state or (-1, None, 0, 0, -1, -1, -1, 0, 0.0, 0, 0)

    def state(self) -> tuple:
        return (self.number, self.at, self.above, self.below, self.trigger, self.first, self.last, self.n, self.total, self.since, self.closed)

    def _end(self, closed: int) -> list[tuple]:
        out = [(self.trigger, self.first, self.last, self.n, self.total)] if self.trigger >= 0 else []
        self.trigger, self.closed, self.below = -1, closed, 0
        return out

    def silence(self) -> list[tuple]:
        """The session that silence ends, if one runs."""
        self.above, self.ring = 0, []
        return self._end(self.number + 1)

    def add(self, number: int, at: int, value: float | None) -> list[tuple]:
        """The session that ends at this sample, or before it."""
        if number <= self.number:
            return []
        silent = self.at is not None and at - self.at > self.spec.silence * 1_000_000
        out = self.silence() if silent else []
        self.number, self.at = number, at
        missing = value is None or value != value
        self.above = self.above + 1 if not missing and value >= self.spec.on else 0
        self.below = self.below + 1 if not missing and value < self.spec.off else 0
        if self.trigger >= 0 and self.below >= self.spec.end_filter:
            out += self._end(number)
            self.ring = []
        elif self.trigger < 0 and self.above > self.spec.filter:
            self.trigger, self.since, self.n, self.total = number, 0, len(self.ring), sum(v for _, v in self.ring if v is not None)
            self.first = self.ring[0][0] if self.ring else number
            self.ring = []
        if self.trigger >= 0:
            self.last = number
            if self.since >= self.spec.hold:
                self.n += 1
                self.total += 0.0 if missing else value
            self.since += 1
        elif self.spec.before:
            self.ring = [*self.ring, (number, None if missing else float(value))][-self.spec.before :]
        return out


def stream_sessions(samples: DataFrame, trigger: Trigger, delay: str = "1 minute") -> DataFrame:
    """Sessions of a streaming table (channel, ts, number, value), as operators.sessions.sessions; needs Spark's RocksDB state store."""
    rows = samples.select("channel", "ts", "number", "value").withWatermark("ts", delay)
    return rows.groupBy("channel").transformWithStateInPandas(TriggerProcessor(trigger), SCHEMA, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state of one's own needs."""
    with settings(spark, ROCKSDB):
        yield


def replay_sessions(samples: DataFrame, trigger: Trigger, slices: int = 2, files: int = 2, delay: str = "1 minute") -> DataFrame:
    """Plays a table (channel, ts, number, value) as a stream of time slices through the trigger."""
    spark = samples.sparkSession
    folder = own_folder(spark, "sessions")
    in_time_slices(samples, "ts", f"{folder}/in", slices, files)
    with rocksdb(spark):
        return run_available(stream_sessions(file_stream(spark, samples, f"{folder}/in", files), trigger, delay), folder)[0]

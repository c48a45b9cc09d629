"""Jobs as a stream: updates in, endings and updates that do not count out, by the rules of operators.lifecycle.

One state a job: where it stands, its last sign of life, and updates that wait until the watermark has passed them, so
that they are judged in the order of their times whatever the order they come in. Event-time timers wake a job for the
updates that wait and when its heartbeat has been missing for the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.lifecycle import ILLEGAL, INTERRUPTED, JOB, LATE, Machine


class JobLife(StatefulProcessor):
    """State: now (number in machine.states), last (µs of the last legal update), and the waiting updates."""

    def __init__(self, machine: Machine, gap_us: int):
        self.machine, self.gap = machine, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "now int, last bigint")
        self.waiting = handle.getListState("waiting", "ts bigint, place bigint, state string")

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)  # the watermark has milliseconds: what it passed cannot come any more

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.appendValue((r["ts_us"], r["place"], r["state"]))
            self._timer(r["ts_us"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        now, last = self.job.get() if self.job.exists() else (0, None)
        rows = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        due, later = [w for w in rows if w[0] <= passed], [w for w in rows if w[0] > passed]
        out = []
        over = lambda: self.machine.states[now] in self.machine.terminal

        def interrupt() -> int:
            out.append((last + self.gap, INTERRUPTED))
            return self.machine.states.index(INTERRUPTED)

        for ts, _, state in due:
            state = state or None
            if not over() and last is not None and ts > last + self.gap:
                now = interrupt()
            if over():
                out.append((ts, LATE))
            elif not self.machine.legal(now, state):
                out.append((ts, ILLEGAL))
            else:
                now, last = self.machine.after(now, state), ts
                if over():
                    out.append((ts, state))
                else:
                    self._timer(last + self.gap)
        if not over() and last is not None and passed > last + self.gap:
            now = interrupt()
        self.job.update((now, last))
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        for us, kind in out:
            yield Row(job=key[0], us=us, kind=kind)

    def close(self) -> None:
        pass


def endings(updates: DataFrame, by: str, ts: str, place: str, state: str, gap_seconds: int, lateness: str = "1 hour", machine: Machine = JOB) -> DataFrame:
    """by, ts, kind as operators.lifecycle.endings gives them, each row once; place (whole numbers) orders equal times.

    The session's state store must be RocksDB. Updates that come later than lateness behind the newest are dropped by the
    watermark; null times are dropped too. A job that has ended keeps two numbers of state, so that later updates stay late.
    Null jobs are one job; a null state is illegal; equal updates all count.
    """
    stream = updates.where(F.col(ts).isNotNull()).select(F.col(by).alias("job"), F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"), F.coalesce(F.col(place).cast("long"), F.lit(-1)).alias("place"), F.coalesce(F.col(state), F.lit("")).alias("state"))
    schema = T.StructType([T.StructField("job", stream.schema["job"].dataType), T.StructField("us", T.LongType()), T.StructField("kind", T.StringType())])
    grouped = stream.withWatermark("at", lateness).groupBy("job")
    out = grouped.transformWithState(statefulProcessor=JobLife(machine, gap_seconds * 1_000_000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(F.col("job").alias(by), F.timestamp_micros("us").alias(ts), "kind")

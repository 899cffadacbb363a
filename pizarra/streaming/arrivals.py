"""Watching deliveries: which departments' files are there, which are late.

A delivery (a month, a school year) is complete when a file of every expected
department has landed. The stream keeps, per delivery, the departments that have, and
a timer at its due time. It says ``complete`` when the last one lands in time;
otherwise the timer says ``missing`` for each that is absent, and what lands after it
is ``late``. ``report`` gives the same answer for a table that is whole.

State: one small entry per department of an open delivery. Deliveries are spread over
the tasks by their key; one delivery has at most as many rows of interest as there are
departments, since rows are first reduced to the earliest landing per department and
batch. Repeated and replayed files change nothing: a department lands once.

Nulls: rows without a delivery, department or time are not arrivals; departments that
are not expected are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .ingest import own_checkpoint

EVENTS = "delivery string, status string, department int, at timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Arrivals(StatefulProcessor):
    def __init__(self, expected: Sequence[int]):
        self.expected = frozenset(expected)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.landed = handle.getMapState("landed", "department int", "at timestamp")
        self.closed = handle.getValueState("closed", "overdue boolean")

    def _out(self, delivery: str, rows: list[tuple]) -> Iterable[pd.DataFrame]:
        if rows:
            out = pd.DataFrame([(delivery, *r) for r in rows], columns=["delivery", "status", "department", "at"])
            yield out.astype({"department": "Int32"})

    def handleInputRows(self, key, rows, timerValues):
        (delivery,) = key
        found = pd.concat(list(rows)).sort_values(["at", "department"])
        overdue = self.closed.exists() and self.closed.get()[0]
        out = []
        for department, at, due in found[["department", "at", "due"]].itertuples(index=False):
            if int(department) not in self.expected or self.landed.containsKey((int(department),)):
                continue
            if not list(self.handle.listTimers()) and not self.closed.exists():
                self.handle.registerTimer(_millis(due))
            self.landed.updateValue((int(department),), (at.to_pydatetime(),))
            if overdue or at > due:
                out.append(("late", int(department), at))
            elif len(list(self.landed.keys())) == len(self.expected):
                out.append(("complete", None, at))
                self.closed.update((False,))
                for (timer,) in ((t,) for t in list(self.handle.listTimers())):
                    self.handle.deleteTimer(timer)
        yield from self._out(delivery, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (delivery,) = key
        due = expiredTimerInfo.getExpiryTimeInMs()
        at = pd.Timestamp(due, unit="ms")
        # a file that landed after the due time, before the watermark passed it, was said to be late already
        here = {k[0] for k in self.landed.keys() if _millis(pd.Timestamp(self.landed.getValue(k)[0])) <= due}
        if not self.closed.exists():
            self.closed.update((True,))
            yield from self._out(delivery, [("missing", d, at) for d in sorted(self.expected - here)])

    def close(self) -> None:
        pass


def _millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def _arrivals(df: DataFrame, expected: Sequence[int]) -> DataFrame:
    known = df.where("delivery is not null and department is not null and at is not null and due is not null")
    return known.where(F.col("department").isin(*expected)).select("delivery", F.col("department").cast("int").alias("department"), F.col("at").cast("timestamp").alias("at"), F.col("due").cast("timestamp").alias("due"))


def watch(stream: DataFrame, expected: Sequence[int], delay: str) -> DataFrame:
    """From a stream (delivery, department, at, due): (delivery, status, department,
    at). Needs the RocksDB state store (``start_watch`` sees to it) and the session's
    zone to be UTC."""
    marked = _arrivals(stream, expected).withWatermark("at", delay)
    return marked.groupBy("delivery").transformWithStateInPandas(
        statefulProcessor=Arrivals(expected), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime"
    )


def start_watch(spark: SparkSession, stream: DataFrame, table: str, expected: Sequence[int], delay: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append what is said about deliveries to a Parquet table, exactly once."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = watch(stream, expected, delay).writeStream.format("parquet").option("path", table).outputMode("append")
        return writer.option("checkpointLocation", checkpoint or own_checkpoint(spark, table)).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def report(df: DataFrame, expected: Sequence[int], until: datetime | None = None) -> DataFrame:
    """The same for a whole table; ``until`` leaves out alarms due later."""
    first = _arrivals(df, expected).groupBy("delivery", "department").agg(F.min("at").alias("at"), F.min("due").alias("due"))
    deliveries = first.groupBy("delivery").agg(
        F.min("due").alias("due"), F.count_if(F.col("at") <= F.col("due")).alias("n"), F.max(F.when(F.col("at") <= F.col("due"), F.col("at"))).alias("last")
    )
    all_in = F.col("n") == len(expected)
    complete = deliveries.where(all_in).select("delivery", F.lit("complete").alias("status"), F.lit(None).cast("int").alias("department"), F.col("last").alias("at"))
    open_ = deliveries.where(~all_in) if until is None else deliveries.where(~all_in & (F.col("due") <= F.lit(until)))
    wanted = open_.select("delivery", "due", F.explode(F.array(*map(F.lit, expected))).alias("department"))
    missing = wanted.join(first.where("at <= due").select("delivery", "department"), ["delivery", "department"], "left_anti")
    late = first.where("at > due").select("delivery", F.lit("late").alias("status"), "department", "at")
    return complete.unionByName(missing.select("delivery", F.lit("missing").alias("status"), "department", F.col("due").alias("at"))).unionByName(late)

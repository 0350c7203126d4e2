"""Step times of a live log with event-time timers.

A step's time needs its predecessor, and rows arrive out of order.  Every run
holds its rows in list state until the watermark (newest time of the whole
stream less the declared lateness) has passed them: from then on no earlier row
can come.  A timer at the oldest held row wakes the run, also when the run
itself gets no more rows, so no end marker is needed and idle runs are emitted.
When nothing has come for ``idle_seconds`` of event time after a run's last
row, its state is freed; a run that goes on after that starts anew (0.0).

A run's state holds the rows within the lateness and one time.  Runs share the
state, timer and calls of a bucket (:func:`run_bucket`), so calls do not grow
with the number of runs.  Rows older than
the watermark are dropped by Spark and counted in the query's progress
(``numRowsDroppedByWatermark``).  Rows of equal time are ordered by step.

The watermark only moves with data: a live log moves it by itself, a finished
one by a heartbeat (a row with a time and no step).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import epoch_micros
from .runs import HELD, NONE, held_rows, run_bucket, run_ids, step_deltas

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("step_time_ms", T.DoubleType())])
ROWS = T.StructType([T.StructField("rows", T.BinaryType())])  # HELD or LAST
LAST = np.dtype([("run", "<i8"), ("us", "<i8")])


class StepTimes(StatefulProcessor):
    """All runs of a bucket: their held rows, and the last time of each."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ROWS)
        self.last = handle.getValueState("last", ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = []
        for part in rows:
            if len(part):
                new = held_rows(part)
                self.held.appendValue((new.tobytes(),))
                oldest.append(int(new["us"].min()))
        if oldest:
            self.handle.registerTimer(-(-min(oldest) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.concatenate([np.zeros(0, HELD), *(np.frombuffer(r[0], HELD) for r in self.held.get())])
        known = np.frombuffer(self.last.get()[0], LAST) if self.last.exists() else np.zeros(0, LAST)
        held = held[np.lexsort((held["step"], held["us"], held["run"]))]
        due = held["us"] <= upto
        done, rest = held[due], held[~due]
        names = np.union1d(known["run"], done["run"])
        last = np.full(len(names), NONE)
        last[np.searchsorted(names, known["run"])] = known["us"]
        if len(done):
            delta = step_deltas(np.searchsorted(names, done["run"]), done["us"], last)
            yield pd.DataFrame({"run_id": run_ids(key[0], done["run"]), "step": done["step"], "loss": done["loss"], "step_time_ms": delta})
            if len(rest):
                self.held.put([(rest.tobytes(),)])
            else:
                self.held.clear()
        waits = np.isin(names, rest["run"])
        idle = -(-last // 1000) + self.idle_ms
        stays = waits | (upto < idle * 1000)  # else the run is over: nothing of it is left in the store
        if stays.any():
            table = np.empty(int(stays.sum()), LAST)
            table["run"], table["us"] = names[stays], last[stays]
            self.last.update((table.tobytes(),))
        elif len(known):
            self.last.clear()
        wake = [-(-rest["us"].min() // 1000)] if len(rest) else []
        wake += [idle[stays & ~waits].min()] if (stays & ~waits).any() else []
        if wake:
            self.handle.registerTimer(int(min(wake)))


def step_times_timers(steps: DataFrame, lateness_seconds: float, idle_seconds: float) -> DataFrame:
    """``run_id, step, loss, step_time_ms`` in append mode; needs the RocksDB
    state store (:func:`with_rocksdb`)."""
    timed = steps.withColumn("us", epoch_micros(F.col("ts"))).withColumn("ts", F.timestamp_micros("us"))
    marked = timed.withWatermark("ts", f"{int(lateness_seconds * 1000)} milliseconds")
    # one condition with the event time in it, so that no part of it is moved below the watermark, which heartbeats must reach
    rows = marked.where(F.when(F.col("ts").isNotNull(), F.col("step").isNotNull()).otherwise(False))
    run = F.coalesce(F.col("run_id").cast("long"), F.lit(0).cast("long"))
    keyed = rows.select(run_bucket().alias("bucket"), run.alias("run"), "step", "loss", "ts", "us").groupBy("bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=StepTimes(int(idle_seconds * 1000)), outputStructType=OUT, outputMode="append", timeMode="EventTime")


class with_rocksdb:
    """The session's state store while queries with timers are started."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        key = "spark.sql.streaming.stateStore.providerClass"
        self.before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, ROCKSDB)

    def __exit__(self, *_):
        key = "spark.sql.streaming.stateStore.providerClass"
        if self.before is None:
            self.spark.conf.unset(key)
        else:
            self.spark.conf.set(key, self.before)

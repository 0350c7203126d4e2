"""Live training-log analytics over an append stream of step records.

``run_summary_stream`` keeps the run summary's aggregates in the state
store (update per micro-batch).  ``step_times_stream`` needs each step's
predecessor, which streaming windows cannot express (``lag`` is not
allowed on streams): keyed state per run holds the rows that may still get
an earlier neighbour.  A row is emitted, in (ts, step) order, once a row of
the run that is more than ``lateness`` newer was seen, or once the run's end
marker (a row without a step number) arrives.  So the answer depends on the
declared lateness alone, not on files per trigger or on the order of arrival
within it.  A row that is older still, and so comes after its successor was
emitted, gets a NULL step time and ``late = true``.  State per run is
bounded by the rows within the lateness.  Runs are keyed by hash into
``BUCKETS`` groups, each handled in one call on whole columns: calls per
micro-batch do not grow with the number of runs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import epoch_micros


def step_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Stream the ``events`` parquet files as step records.  ``max_files``
    sets the size of a micro-batch, never the answer."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    e = reader.parquet(path)
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "ts",
        F.col("value").alias("loss"),
        (F.get_json_object("props", "$.k").cast("double") / 10.0).alias("memory_gb"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value") * 100).alias("gpu_memory_mb"))


def run_summary_stream(steps: DataFrame) -> DataFrame:
    """Streaming aggregation with the batch run summary's columns."""
    us = epoch_micros(F.col("ts"))
    order = F.struct(F.col("ts"), F.col("step"))
    agg = steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.min(us).alias("__first"), F.max(us).alias("__last"),
        F.max("memory_gb").alias("peak_memory_gb"),
        F.max(F.coalesce(F.col("gpu_memory_mb"), F.lit(0.0))).alias("peak_gpu_memory_mb"),
        F.max_by(F.col("loss"), order).alias("final_loss"))
    return agg


def finish_run_summary(df: DataFrame) -> DataFrame:
    span = F.col("__last") - F.col("__first")
    return df.select("run_id", "total_steps", (span / 1e6).alias("total_time_s"),
                     (span / 1000.0 / F.col("total_steps")).alias("avg_step_time_ms"),
                     "peak_memory_gb", "peak_gpu_memory_mb", "final_loss")


STEP_OUT = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("step", T.LongType()),
                         T.StructField("loss", T.DoubleType()), T.StructField("step_time_ms", T.DoubleType()),
                         T.StructField("late", T.BooleanType())])
BUCKETS = 512  # groups of runs; a stream's checkpoint is bound to it
NONE = np.iinfo(np.int64).min
RUN = np.dtype([("run", "<i8"), ("newest", "<i8"), ("last", "<i8")])
HELD = np.dtype([("run", "<i8"), ("us", "<i8"), ("step", "<i8"), ("loss", "<f8")])
STEP_STATE = T.StructType([T.StructField("runs", T.BinaryType()), T.StructField("held", T.BinaryType())])  # RUN, HELD


def run_bucket() -> Column:
    """The group a run belongs to; -1 for the null run, which is alone there."""
    run = F.col("run_id").cast("long")
    return F.when(run.isNull(), F.lit(-1)).otherwise(F.pmod(F.hash(run), F.lit(BUCKETS)))


def run_ids(bucket: int, runs: np.ndarray):
    return runs if bucket >= 0 else np.full(len(runs), None)


def held_rows(part: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(part), HELD)
    for name, dtype in HELD.fields.items():
        out[name] = part[name].to_numpy(dtype=dtype[0])
    return out


def step_deltas(at: np.ndarray, us: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Milliseconds since the run's step before, of rows sorted by run (place
    ``at`` in ``last``) and time; ``last`` then holds each run's newest."""
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = at[1:] != at[:-1]
    before = np.where(edge[:-1], last[at], np.roll(us, 1))
    last[at[edge[1:]]] = us[edge[1:]]
    return np.where(before == NONE, 0.0, (us - before) / 1000.0)


def _step_state(lateness_us: int, key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One call for all the rows of a bucket's runs."""
    frames = [p for p in pdfs if not p.empty]
    if not frames:
        return
    new = pd.concat(frames, ignore_index=True)
    rows, ends = held_rows(new), new["ends"].to_numpy(dtype=bool)
    known, held = (np.frombuffer(x, t) for x, t in zip(state.get, (RUN, HELD))) if state.exists else (np.zeros(0, RUN), np.zeros(0, HELD))
    names = np.union1d(known["run"], rows["run"])
    table = np.full(len(names), NONE, RUN)
    table["run"] = names
    table[np.searchsorted(names, known["run"])] = known
    newest, last, closed = table["newest"], table["last"], np.isin(names, rows["run"][ends])
    rows = rows[~ends]
    at = np.searchsorted(names, rows["run"])
    late = rows["us"] < last[at]
    np.maximum.at(newest, at, rows["us"])
    late_rows, live = rows[late], np.concatenate([held, rows[~late]])
    live = live[np.lexsort((live["step"], live["us"], live["run"]))]
    at = np.searchsorted(names, live["run"])
    due = closed[at] | (live["us"] < newest[at] - lateness_us)
    done = live[due]
    delta = step_deltas(at[due], done["us"], last)
    state.update((table.tobytes(), live[~due].tobytes()))
    out = np.concatenate([done, late_rows])
    yield pd.DataFrame({"run_id": run_ids(key[0], out["run"]), "step": out["step"], "loss": out["loss"],
                        "step_time_ms": np.concatenate([delta, np.full(len(late_rows), np.nan)]),
                        "late": np.arange(len(out)) >= len(done)})


def step_times_stream(steps: DataFrame, lateness_seconds: float) -> DataFrame:
    """``run_id, step, loss, step_time_ms, late`` in append mode."""
    zero = F.lit(0).cast("long")
    rows = steps.select(run_bucket().alias("bucket"), F.coalesce(F.col("run_id").cast("long"), zero).alias("run"), epoch_micros(F.col("ts")).alias("us"),
                        F.coalesce(F.col("step"), zero).alias("step"), "loss", F.col("step").isNull().alias("ends"))
    return (rows.groupBy("bucket")
                .applyInPandasWithState(functools.partial(_step_state, int(lateness_seconds * 1_000_000)), STEP_OUT,
                                        STEP_STATE, "append", GroupStateTimeout.NoTimeout))


def run_to_table(query_df: DataFrame, out_path: str, checkpoint: str, mode: str) -> None:
    """Run a streaming query to completion over the data available now.

    Every micro-batch is written to its own ``epoch=<id>`` folder with
    overwrite, so a batch replayed after a failure replaces its own output
    instead of duplicating it (the sink is idempotent).  ``append``: the
    folders together are the output.  ``update``: each batch holds only the
    keys whose aggregate changed, so the folders form a changelog whose
    latest row per key is the current state (:func:`latest_state`); no batch
    rewrites the whole result.  ``complete``: each batch overwrites the full
    result (small results only).
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out_path)
        else:
            batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (query_df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_table(spark: SparkSession, out_path: str) -> DataFrame:
    """Rows written by :func:`run_to_table` in append mode."""
    return spark.read.parquet(out_path).drop("epoch")


def latest_state(changelog: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row per key of an update-mode changelog (map-side combined)."""
    values = [c for c in changelog.columns if c not in keys and c != "epoch"]
    latest = changelog.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.col("epoch")).alias("__s"))
    return latest.select(*keys, *[F.col(f"__s.{c}").alias(c) for c in values])

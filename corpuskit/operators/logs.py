"""Training-log analytics: step times, run summaries, checkpoint selection.

``step_times`` needs each row's predecessor within its run.  A window
partitioned by run would put a whole run into one task, and one run may
hold a large share of a log.  Instead the window is partitioned by run and
time bucket, which splits a long run across tasks; the first row of a bucket
takes its predecessor from the last time of the run's previous bucket, a
table with one row per (run, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_micros


def step_times(steps: DataFrame, run: str = "run_id", ts: str = "ts", step: str = "step",
               bucket_seconds: int = 3600) -> DataFrame:
    """Milliseconds since the previous step of the same run (ordered by
    ``ts`` then ``step``); the first step of a run is 0.0."""
    us = epoch_micros(F.col(ts))
    base = steps.withColumn("__us", us).withColumn("__bucket", F.floor(F.col("__us") / (bucket_seconds * 1_000_000)))
    inside = Window.partitionBy(run, "__bucket").orderBy("__us", step)
    local = base.withColumn("__prev", F.lag("__us").over(inside))
    # last time of every (run, bucket), moved on to the run's next bucket
    tails = base.groupBy(run, "__bucket").agg(F.max("__us").alias("__last"))
    moved = tails.select(F.col(run).alias("__run"), F.col("__bucket").alias("__b"),
                         F.lag("__last").over(Window.partitionBy(run).orderBy("__bucket")).alias("__before"))
    joined = local.join(moved, F.col(run).eqNullSafe(F.col("__run")) & (F.col("__bucket") == F.col("__b")), "left")
    delta = (F.col("__us") - F.coalesce("__prev", "__before")) / 1000.0
    return joined.withColumn("step_time_ms", F.coalesce(delta, F.lit(0.0))) \
                 .drop("__us", "__bucket", "__prev", "__run", "__b", "__before")


def step_times_window(steps: DataFrame, run: str = "run_id", ts: str = "ts",
                      step: str = "step") -> DataFrame:
    """The same result by a window partitioned by run: fine when every run
    is small, used as the cross-check."""
    w = Window.partitionBy(run).orderBy(ts, step)
    us = epoch_micros(F.col(ts))
    return steps.withColumn("step_time_ms", F.coalesce((us - F.lag(us).over(w)) / 1000.0, F.lit(0.0)))


def run_summary(steps: DataFrame, run: str = "run_id", ts: str = "ts", step: str = "step") -> DataFrame:
    """Per run: step count, total time, mean step time (first step's 0
    counted, so it telescopes to (last - first) / count), peak memory,
    peak GPU (NULL as 0) and final loss.  Every aggregate is partial
    (map-side combined), so a long run is never gathered into one task."""
    us = epoch_micros(F.col(ts))
    order = F.struct(F.col(ts), F.col(step))
    return steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_steps"),
        ((F.max(us) - F.min(us)) / 1e6).alias("total_time_s"),
        ((F.max(us) - F.min(us)) / 1000.0 / F.count(F.lit(1))).alias("avg_step_time_ms"),
        F.max("memory_gb").alias("peak_memory_gb"),
        F.max(F.coalesce(F.col("gpu_memory_mb"), F.lit(0.0))).alias("peak_gpu_memory_mb"),
        F.max_by(F.col("loss"), order).alias("final_loss"),
    )


def best_checkpoint(steps: DataFrame, run: str = "run_id", metric: str = "loss", step: str = "step",
                    greater_is_better: bool = False, save_total_limit: int = 2) -> DataFrame:
    """Checkpoints kept per run: the best by ``metric`` (ties: earliest step;
    a step without the metric is never the best) and the newest ``save_total_limit``.  The best is a partial aggregate;
    the newest-k filter plans as a window group limit, which keeps at most k
    rows per run in every task before the shuffle."""
    m = F.col(metric)
    best = steps.filter(m.isNotNull()).groupBy(run).agg(
        F.min_by(F.struct(F.col(step).alias("step"), m.alias("metric")),
                 F.struct((-m if greater_is_better else m), F.col(step))).alias("b"))
    best = best.select(run, F.col("b.step").alias(step), F.col("b.metric").alias(metric),
                       F.lit(True).alias("is_best"), F.lit(False).alias("is_recent"))
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    recent = (steps.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= save_total_limit)
              .select(run, step, metric, F.lit(False).alias("is_best"), F.lit(True).alias("is_recent")))
    return (best.unionByName(recent).groupBy(run, step)
            .agg(F.first(metric).alias(metric), F.max("is_best").alias("is_best"),
                 F.max("is_recent").alias("is_recent")))

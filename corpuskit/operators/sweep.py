"""Sweep results: training and evaluation loss of every setting.

Input is a loss log with one row per measurement: ``setting``, ``step``,
``phase`` (``train`` or ``eval``) and ``loss``.  Runs of a sweep need not be of
equal length (some stop early), so settings are compared at the last step that
all of them evaluated.  Every step here is a grouped aggregate; what is
gathered has one row per setting or one per setting and step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def curves(log: DataFrame) -> DataFrame:
    """(setting, step, train_loss, eval_loss): means of a step's measurements;
    a phase that a step lacks is null."""
    of = lambda phase: F.avg(F.when(F.col("phase") == phase, F.col("loss")))
    return log.groupBy("setting", "step").agg(of("train").alias("train_loss"), of("eval").alias("eval_loss"))


def wide_curves(log: DataFrame, settings: list[tuple[float, str]]) -> DataFrame:
    """One row per step: ``train_<name>`` and ``eval_<name>`` of every setting,
    given as (value, name)."""
    per = curves(log)
    picked = [F.max(F.when(F.col("setting") == value, F.col(c))).alias(f"{c.split('_')[0]}_{name}") for value, name in settings for c in ("train_loss", "eval_loss")]
    return per.groupBy("step").agg(*picked)


def sweep_table(log: DataFrame) -> DataFrame:
    """One row per setting: the last step that every setting evaluated
    (``common_step``, null if there is none), the mean training loss of the
    steps up to it, the evaluation loss at it, and the setting's own best
    evaluation (loss, and the first step that has it)."""
    per = curves(log)
    evals = per.where("eval_loss is not null")
    settings = log.select("setting").distinct().agg(F.count(F.lit(1)).alias("__settings"))
    shared = evals.groupBy("step").agg(F.count(F.lit(1)).alias("__n")).crossJoin(F.broadcast(settings))  # one row
    common = shared.where(F.col("__n") == F.col("__settings")).agg(F.max("step").alias("common_step"))
    at = per.crossJoin(F.broadcast(common))  # one row
    best = F.min(F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "step")))
    told = at.groupBy("setting").agg(F.max("common_step").alias("common_step"), F.avg(F.when(F.col("step") <= F.col("common_step"), F.col("train_loss"))).alias("train_loss"),
                                     F.max(F.when(F.col("step") == F.col("common_step"), F.col("eval_loss"))).alias("eval_loss"), best.alias("__best"))
    return told.select("setting", "common_step", "train_loss", "eval_loss", F.col("__best.eval_loss").alias("best_eval_loss"), F.col("__best.step").alias("best_eval_step"))

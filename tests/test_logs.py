import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from corpuskit.operators import logs
from corpuskit.sources import derived

SCHEMA = "run_id long, step long, ts timestamp, loss double, memory_gb double, gpu_memory_mb double"
T0 = dt.datetime(2024, 1, 1)


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_step_times_golden(spark):
    df = _log(spark, [(1, 1, T0, 3.0, 1.0, None), (1, 2, T0 + dt.timedelta(seconds=0.25), 2.0, 2.0, 5.0),
                      (1, 3, T0 + dt.timedelta(seconds=1), 1.0, 1.5, None)])
    got = [r.step_time_ms for r in logs.step_times(df).orderBy("step").collect()]
    assert got == [0.0, 250.0, 750.0]
    s = logs.run_summary(df).first()
    assert s.avg_step_time_ms == pytest.approx(1000 / 3)
    assert (s.total_steps, s.peak_memory_gb, s.peak_gpu_memory_mb, s.final_loss) == (3, 2.0, 5.0, 1.0)


def test_step_times_matches_window_on_events(spark):
    steps = derived.steps(spark, SF_MID)
    a = logs.step_times(steps).select("run_id", "step", "step_time_ms")
    b = logs.step_times_window(steps).select("run_id", "step", "step_time_ms")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_step_times_hot_run_spans_partitions(spark):
    # one run holds most rows: it is split over many time buckets
    rows = [(7, i, T0 + dt.timedelta(milliseconds=10 * i), 1.0, 1.0, None) for i in range(3000)]
    rows += [(r, 0, T0, 1.0, 1.0, None) for r in range(100, 120)]
    df = _log(spark, rows)
    out = logs.step_times(df, bucket_seconds=1)
    hot = out.filter(F.col("run_id") == 7).orderBy("step").collect()
    assert hot[0].step_time_ms == 0.0
    assert all(r.step_time_ms == 10.0 for r in hot[1:])
    assert out.count() == len(rows)


def test_best_checkpoint(spark):
    df = _log(spark, [(1, s, T0, l, 1.0, None) for s, l in [(1, 0.5), (2, 0.3), (3, 0.3), (4, 0.4), (5, 0.6)]])
    got = {(r.step, r.is_best, r.is_recent) for r in logs.best_checkpoint(df, save_total_limit=2).collect()}
    assert got == {(2, True, False), (4, False, True), (5, False, True)}


@pytest.mark.parametrize("seconds", [1, 60, 10 ** 7])
def test_step_times_do_not_depend_on_the_bucket(spark, seconds):
    steps = derived.steps(spark, SF_MID)
    a = logs.step_times(steps, bucket_seconds=seconds).select("run_id", "step", "step_time_ms")
    b = logs.step_times_window(steps).select("run_id", "step", "step_time_ms")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_missing_metric_is_never_best(spark):
    df = _log(spark, [(1, s, T0, l, 1.0, None) for s, l in [(1, None), (2, 0.9), (3, 0.5), (4, 0.7), (5, 0.8)]])
    for greater, want in ((False, 3), (True, 2)):
        best = logs.best_checkpoint(df, greater_is_better=greater).filter("is_best").collect()
        assert [r.step for r in best] == [want]

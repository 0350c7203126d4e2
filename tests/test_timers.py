"""Step times with event-time timers: idle runs, freed state, late rows."""

import datetime as dt
import itertools

import pytest

from corpuskit.session import scratch_path
from corpuskit.streaming import timers

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run_id long, step long, ts timestamp, loss double"


def play(spark, batches, lateness=10.0, idle=50.0):
    """The rows of every micro-batch (run, step, seconds), one file each:
    (rows that were emitted, state rows after the last batch, rows dropped)."""
    src, ck = scratch_path(spark, "tm"), scratch_path(spark, "tm-ck")
    for i, batch in enumerate(batches):
        spark.createDataFrame([(r, s, None if t is None else T0 + dt.timedelta(seconds=t), 1.0) for r, s, t in batch], SCHEMA).coalesce(1).write.parquet(f"{src}/{i}")
    steps = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*/*.parquet")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        with timers.with_rocksdb(spark):
            q = (timers.step_times_timers(steps, lateness, idle).writeStream.outputMode("append").option("checkpointLocation", ck)
                 .foreachBatch(lambda df, i: got.extend((r["run_id"], r["step"], r["step_time_ms"]) for r in df.collect())).trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ops = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return sorted(got), ops[-1]["numRowsTotal"], sum(o["numRowsDroppedByWatermark"] for o in ops)


def test_idle_runs_are_emitted_and_freed(spark):
    """Run 1 gets no row after the first batch; run 2's rows move the watermark."""
    got, state, _ = play(spark, [[(1, 0, 0.0), (1, 1, 1.5), (2, 0, 1.0)], [(2, 1, 30.0)], [(2, 2, 31.0)], [(None, None, 500.0)]])
    assert got == [(1, 0, 0.0), (1, 1, 1500.0), (2, 0, 0.0), (2, 1, 29000.0), (2, 2, 1000.0)]
    assert state == 0


def test_rows_within_the_lateness_wait(spark):
    got, state, _ = play(spark, [[(1, 0, 0.0), (1, 1, 5.0)], [(1, 2, 8.0)]])
    assert got == [] and state > 0


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[1::2])
def test_order_of_arrival_within_the_lateness_is_no_matter(spark, order):
    parts = [[(1, 0, 0.0), (2, 7, 0.25)], [(1, 1, 3.0), (1, 2, 3.0)], [(1, 3, 7.125), (2, 8, 9.0)]]
    got, state, dropped = play(spark, [*[parts[i] for i in order], [(None, None, 1000.0)]])
    assert got == [(1, 0, 0.0), (1, 1, 3000.0), (1, 2, 0.0), (1, 3, 4125.0), (2, 7, 0.0), (2, 8, 8750.0)]
    assert state == 0 and dropped == 0


def test_later_rows_are_dropped_and_counted(spark):
    got, _, dropped = play(spark, [[(1, 0, 0.0), (1, 1, 100.0)], [(1, 2, 110.0)], [(1, 9, 50.0)], [(None, None, 1000.0)]])
    assert got == [(1, 0, 0.0), (1, 1, 100000.0), (1, 2, 10000.0)] and dropped == 1


def test_state_does_not_grow_with_the_number_of_runs(spark, monkeypatch):
    from corpuskit.streaming import runs

    monkeypatch.setattr(runs, "BUCKETS", 3)
    first, second = [(r, 0, 1.0 + r / 100) for r in range(40)], [(r, 1, 5.0 + r % 6) for r in range(40)]
    got, state, _ = play(spark, [first, second], lateness=20.0)
    assert got == [] and 0 < state <= 3 * 4  # two blobs and two timers in each of three buckets
    got, state, dropped = play(spark, [first, second, [(5, 2, 70.0)], [(5, 3, 130.0)], [(None, None, 999.0)]])
    want = [(r, 0, 0.0) for r in range(40)] + [(r, 1, 1000 * (5 + r % 6) - (1000 + 10 * r)) for r in range(40)]
    assert got == sorted([*want, (5, 2, 60000.0), (5, 3, 60000.0)])
    assert state == 0 and dropped == 0

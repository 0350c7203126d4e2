import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuskit.operators import logs
from corpuskit.session import scratch_path
from corpuskit.sources import derived
from corpuskit.sources.tables import table
from corpuskit.streaming import runs


def test_stream_summary_equals_batch(spark):
    steps = runs.step_stream(spark, f"{SF_SMALL}/events*.parquet", table(spark, SF_SMALL, "events").schema)
    out, ck = scratch_path(spark, "t-sum"), scratch_path(spark, "t-sum-ck")
    runs.run_to_table(runs.run_summary_stream(steps), out, ck, "complete")
    stream = runs.finish_run_summary(spark.read.parquet(out))
    batch = logs.run_summary(derived.steps(spark, SF_SMALL))
    assert stream.exceptAll(batch.select(*stream.columns)).count() == 0
    assert stream.count() == batch.count()


def test_stream_step_times_equal_batch(spark):
    steps = runs.step_stream(spark, f"{SF_SMALL}/events*.parquet", table(spark, SF_SMALL, "events").schema)
    out, ck = scratch_path(spark, "t-st"), scratch_path(spark, "t-st-ck")
    # no end marker and a lateness longer than the log: everything is held
    runs.run_to_table(runs.step_times_stream(steps, 10 ** 9), out, ck, "append")
    assert runs.read_table(spark, out).count() == 0


@pytest.mark.parametrize("order,lateness,late", [((2, 1, 0), 10 ** 9, False), ((0, 1, 2), 0, False), ((2, 0, 1), 0, True)])
def test_stream_step_times_over_arrival_orders(spark, order, lateness, late):
    """Three files by time, one per trigger, then the end markers."""
    events = table(spark, SF_SMALL, "events")
    src = scratch_path(spark, "t-ev")
    thirds = events.withColumn("third", F.ntile(3).over(Window.orderBy("ts"))).cache()
    for i, k in enumerate(order):
        thirds.filter(F.col("third") == k + 1).drop("third").coalesce(1).write.parquet(f"{src}/{i}")
    ends = events.select("user_id").distinct()
    ends.select(*[F.col(f.name) if f.name == "user_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).coalesce(1).write.parquet(f"{src}/3")
    steps = runs.step_stream(spark, f"{src}/*/*.parquet", events.schema, max_files=1)
    out, ck = scratch_path(spark, "t-st"), scratch_path(spark, "t-st-ck")
    runs.run_to_table(runs.step_times_stream(steps, lateness), out, ck, "append")
    stream = runs.read_table(spark, out)
    assert stream.count() == events.count()
    if late:  # rows after their successor was emitted are told, not guessed
        assert stream.filter("late").count() > 0 and stream.filter("late and step_time_ms is not null").count() == 0
        return
    batch = logs.step_times_window(derived.steps(spark, SF_SMALL)).select("run_id", "step", "step_time_ms")
    got = stream.select("run_id", "step", "step_time_ms")
    assert stream.filter("late").count() == 0
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_update_mode_changelog_over_several_batches(spark):
    import tempfile

    import pyarrow.parquet as pq

    src = tempfile.mkdtemp(prefix="events-")
    events = table(spark, SF_SMALL, "events")
    # three files arriving as three micro-batches (one file per trigger)
    whole = pq.read_table(f"{SF_SMALL}/events.parquet")
    third = (whole.num_rows + 2) // 3
    for i in range(3):
        pq.write_table(whole.slice(i * third, third), f"{src}/events-{i}.parquet")
    steps = runs.step_stream(spark, f"{src}/events-*.parquet", events.schema, max_files=1)
    out, ck = scratch_path(spark, "t-upd"), scratch_path(spark, "t-upd-ck")
    runs.run_to_table(runs.run_summary_stream(steps), out, ck, "update")
    log = spark.read.parquet(out)
    assert log.select("epoch").distinct().count() == 3
    stream = runs.finish_run_summary(runs.latest_state(log, ["run_id"]))
    batch = logs.run_summary(derived.steps(spark, SF_SMALL))
    assert stream.exceptAll(batch.select(*stream.columns)).count() == 0
    assert stream.count() == batch.count()


def test_step_state_does_not_grow_with_the_number_of_runs(spark, monkeypatch):
    """Runs share buckets, the null run too; a row without a step ends its run alone."""
    import datetime as dt

    monkeypatch.setattr(runs, "BUCKETS", 2)
    t0, schema = dt.datetime(2024, 1, 1), "run_id long, step long, ts timestamp, loss double"
    src, ck = scratch_path(spark, "t-bk"), scratch_path(spark, "t-bk-ck")
    batches = [[(r, 1, 2.0) for r in range(30)] + [(None, 1, 1.0)], [(r, 0, r / 64) for r in range(30)] + [(None, 2, 1.5)], [(r, None, 0.0) for r in [*range(29), None]]]
    for i, batch in enumerate(batches):
        spark.createDataFrame([(r, s, t0 + dt.timedelta(seconds=t), None) for r, s, t in batch], schema).coalesce(1).write.parquet(f"{src}/{i}")
    got, steps = [], spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*/*.parquet")
    q = (runs.step_times_stream(steps, 60).writeStream.outputMode("append").option("checkpointLocation", ck)
         .foreachBatch(lambda df, i: got.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start())
    q.awaitTermination()
    want = {(r, 0, None, 0.0, False) for r in range(29)} | {(r, 1, None, 2000 - r * 1000 / 64, False) for r in range(29)}
    assert len(got) == 60 and set(got) == want | {(None, 1, None, 0.0, False), (None, 2, None, 500.0, False)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3


@pytest.mark.parametrize("query", ["step_times_stream", "step_times_timers"])
def test_a_log_of_many_files_takes_no_more_micro_batches(spark, monkeypatch, query):
    from corpuskit.plans import queries_io

    sf, asked, step_stream = scratch_path(spark, "t-sf"), [], runs.step_stream
    table(spark, SF_SMALL, "events").repartition(3).write.parquet(f"{sf}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    monkeypatch.setattr(runs, "step_stream", lambda *a, max_files=None: asked.append(max_files) or step_stream(*a, max_files=max_files))
    try:
        got = getattr(queries_io, query)(spark, sf)
        assert asked[0] > 1 and got.count() == table(spark, SF_SMALL, "events").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

"""Registered queries: file round trips, parser-based cleaning, stemmed
ROUGE, the end-to-end evaluation report and the
streaming log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html as html_ops
from ..plans import evaluate
from ..session import scratch_path
from ..sources import derived, files
from ..sources.tables import table
from ..functions.text import PY_SPACE, whitespace_word_count
from ..functions.time import epoch_micros
from ..streaming import runs, timers
from .oracle import html_to_text_sql, with_views
from .queries_eval import RUN_SUMMARY_SQL, STEP_TIME_SQL, SUMMARY_SQL, round_doubles, summary_df, _r
from .queries_metrics import BLEU, R1, R2, RL, scores_sql
from .queries_prep import QA_SQL_CTE, SPLIT_SQL_CTE, split_df
from .registry import register


@register("scan_qa", with_views("select Id, Title, Body, Score from questions", "questions"))
def scan_qa(spark, sf):
    """Questions written as a quoted multi-line CSV dump and scanned back
    with an explicit schema."""
    q = derived.questions(spark, sf).select(
        "Id", F.lit(None).cast("long").alias("OwnerUserId"), F.lit(None).cast("string").alias("CreationDate"),
        F.lit(None).cast("string").alias("ClosedDate"), "Score", "Title", "Body")
    path = scratch_path(spark, "questions-csv")
    files.write_qa_csv(q, path)
    return files.read_qa_csv(spark, path, files.QUESTIONS_SCHEMA).select("Id", "Title", "Body", "Score")


_PROMPT_SQL = "'Question: ' || question_title || chr(10) || question_body || chr(10) || 'Answer:'"


@register("scan_qa_splits", with_views("select Id, Title, Body, Score from questions", "questions"))
def scan_qa_splits(spark, sf):
    """The questions as one multi-line CSV file, scanned back by splits."""
    q = derived.questions(spark, sf).select(
        "Id", F.lit(None).cast("long").alias("OwnerUserId"), F.lit(None).cast("string").alias("CreationDate"),
        F.lit(None).cast("string").alias("ClosedDate"), "Score", "Title", "Body")
    path = scratch_path(spark, "questions-one-csv")
    files.write_qa_csv(q.coalesce(1), path)
    return files.read_qa_csv_splits(spark, path, files.QUESTIONS_SCHEMA).select("Id", "Title", "Body", "Score")


@register("scan_samples", with_views(
    f"select {_PROMPT_SQL} as prompt, answer from sp where split = 'test'", "questions", "answers",
    extra={"qa": QA_SQL_CTE, "sp": SPLIT_SQL_CTE}))
def scan_samples(spark, sf):
    """The test split written as prompt/answer JSONL and read back."""
    test = split_df(spark, sf).filter(F.col("split") == "test")
    samples = evaluate.prompt_table(test).select("prompt", F.col("reference").alias("answer"))
    path = scratch_path(spark, "samples-jsonl")
    files.write_jsonl(samples, path)
    return files.read_samples(spark, path).select("prompt", "answer")


@register("read_predictions", """
    select (row_number() over (order by conv_id, turn) - 1)::bigint as idx, text
    from conversations where role = 'assistant'""")
def read_predictions(spark, sf):
    """Predictions written as ``{"text": ...}`` JSON lines in (conv_id, turn)
    order (a distributed sort), then read back and numbered in read order
    without a global window."""
    c = (table(spark, sf, "conversations").filter(F.col("role") == "assistant")
         .orderBy("conv_id", "turn").select("text"))
    path = scratch_path(spark, "predictions-jsonl")
    c.write.mode("overwrite").json(path)
    return files.read_predictions(spark, path, "jsonl")


_PREDICTED = """
    select (row_number() over (order by conv_id, turn) - 1)::bigint as idx, text
    from conversations where role = 'assistant'"""


def _listed(spark, sf, key, reader=files.read_predictions):
    """The answers of all conversations as one JSON document holding a list,
    the shape of a results file (one document, in parts)."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    path = scratch_path(spark, "predictions-json")
    head, tail = (f'{{"{key}":[', "]}") if key else ("[", "]")
    files.write_list(c, path, ["conv_id", "turn"], "text", head, tail)
    return reader(spark, path, key or "array", parts=True)


@register("read_responses_object", _PREDICTED)
def read_responses_object(spark, sf):
    return _listed(spark, sf, "responses")


@register("read_predictions_object", _PREDICTED)
def read_predictions_object(spark, sf):
    return _listed(spark, sf, "predictions")


@register("read_references_array", _PREDICTED)
def read_references_array(spark, sf):
    return _listed(spark, sf, None)


@register("read_responses_splits", _PREDICTED)
def read_responses_splits(spark, sf):
    """The answers in one document under a key, read back by splits."""
    return _listed(spark, sf, "responses", files.read_predictions_splits)


@register("write_evaluation", """
    select (row_number() over (order by conv_id, turn) - 1)::bigint as idx, text, count(*) over () as answers
    from conversations where role = 'assistant'""")
def write_evaluation(spark, sf):
    """Metrics and responses written as one document; both parts read back."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "text")
    path = scratch_path(spark, "evaluation-json")
    files.write_evaluation(c.agg(F.count("*").alias("answers")), c, path)
    metrics = files.read_evaluation_metrics(spark, path, "answers: bigint")
    return files.read_predictions(spark, path, "responses", parts=True).crossJoin(F.broadcast(metrics))


@register("scan_answers", with_views("select Id, ParentId, Body, Score from answers", "answers"))
def scan_answers(spark, sf):
    """Answers written as a quoted multi-line CSV dump and scanned back with
    an explicit schema."""
    a = derived.answers(spark, sf).select(
        "Id", F.lit(None).cast("long").alias("OwnerUserId"), F.lit(None).cast("string").alias("CreationDate"), "ParentId", "Score", "Body")
    path = scratch_path(spark, "answers-csv")
    files.write_qa_csv(a, path)
    return files.read_qa_csv(spark, path, files.ANSWERS_SCHEMA).select("Id", "ParentId", "Body", "Score")


@register("write_roundtrip", with_views(
    "select method, total_samples, total_tokens, " + _r(
        "avg_tokens_per_sample avg_latency_seconds p95_latency_seconds avg_throughput_tokens_per_sec "
        "avg_cpu_percent avg_memory_percent avg_gpu_memory_mb rouge1_f1 rouge2_f1 rougeL_f1 bleu_score")
    + " from s", "samples", extra={"s": SUMMARY_SQL}))
def write_roundtrip(spark, sf):
    """The per-method summary written as CSV, JSON and parquet (one file
    each: one row per method); the CSV and JSON copies are read back with the
    parquet copy's schema, and a row is returned only if all three hold it."""
    base = scratch_path(spark, "summary")
    files.write_results(round_doubles(summary_df(spark, sf)), f"{base}/parquet", "parquet", single_file=True)
    s = spark.read.parquet(f"{base}/parquet")  # computed once, copied to the other formats
    files.write_results(s, f"{base}/csv", "csv", single_file=True)
    files.write_results(s, f"{base}/json", "json", single_file=True)
    csv = spark.read.schema(s.schema).option("header", "true").csv(f"{base}/csv")
    return s.intersect(csv).intersect(spark.read.schema(s.schema).json(f"{base}/json"))


@register("clean_html_parser", f"select page_id, {html_to_text_sql('html')} as text from pages")
def clean_html_parser(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_ops.html_to_text_parser(F.col("html")).alias("text"))


_STORED = """
    select 'm' || (k % 3) as method, 'stored' as kind, length(hyp) / 1000.0 as latency,
           len(list_filter(regexp_split_to_array(hyp, '[{space}]+'), lambda w: w <> ''))::integer as num_tokens,
           (k % 97)::double as cpu_percent, (k % 31)::double as memory_percent,
           case when k % 5 = 0 then null else (k % 1000)::double end as gpu_memory_mb, k
    from (select pair_id as k, hypothesis as hyp from pairs)""".replace("{space}", PY_SPACE)


@register("eval_report", scores_sql(f""",
    timed as ({_STORED}),
    samples as (select method, num_tokens, latency, cpu_percent, memory_percent, gpu_memory_mb, {R1} as rouge1_f1, {R2} as rouge2_f1,
                       {RL} as "rougeL_f1", {BLEU} as bleu_score from scored join timed on timed.k = scored.pair_id)
    select method, total_samples, total_tokens, """ + _r(
        "avg_tokens_per_sample avg_latency_seconds p95_latency_seconds avg_throughput_tokens_per_sec "
        "avg_cpu_percent avg_memory_percent avg_gpu_memory_mb rouge1_f1 rouge2_f1 rougeL_f1 bleu_score").replace(", 6)", ", 4)")
    + f" from ({SUMMARY_SQL})", True))
def eval_report(spark, sf):
    """Stored responses (the next conversation's turns, three methods) ->
    scoring -> per-method report."""
    p = derived.score_pairs(spark, sf)
    k, hyp = F.col("pair_id"), F.col("hypothesis")
    responses = p.select(
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("method"), k.alias("idx"), "reference", hyp.alias("response"),
        (F.length(hyp) / 1000.0).alias("latency"), whitespace_word_count(hyp).alias("num_tokens"),
        (k % 97).cast("double").alias("cpu_percent"), (k % 31).cast("double").alias("memory_percent"),
        F.when(k % 5 != 0, (k % 1000).cast("double")).alias("gpu_memory_mb"))
    return round_doubles(evaluate.evaluation_report(responses), 4)


def _events_schema(spark, sf):
    return table(spark, sf, "events").schema


@register("run_summary_stream", with_views(RUN_SUMMARY_SQL, "steps"))
def run_summary_stream(spark, sf):
    """Run summary maintained by a streaming aggregation over the events
    files (update mode: each micro-batch appends the runs it changed; the
    latest row per run is the summary), processed to the end of the
    available data."""
    steps = runs.step_stream(spark, f"{sf.rstrip('/')}/events*.parquet", _events_schema(spark, sf))
    out, ck = scratch_path(spark, "run-summary-stream"), scratch_path(spark, "run-summary-ckpt")
    runs.run_to_table(runs.run_summary_stream(steps), out, ck, "update")
    return round_doubles(runs.finish_run_summary(runs.latest_state(spark.read.parquet(out), ["run_id"])))


def _arrival_files(spark, src, schema):
    """The most files of one of the five arrivals: a micro-batch of as many
    takes about one arrival, however many files the log has."""
    return max(len(spark.read.schema(schema).parquet(f"{src}/{k}").inputFiles()) for k in range(5))


@register("step_times_stream", with_views(
    f"select run_id, step, loss, round({STEP_TIME_SQL}, 6) as step_time_ms, false as late from steps", "steps"))
def step_times_stream(spark, sf):
    """Step times from keyed streaming state.  The events arrive as four
    slices of time in the order 2, 1, 4, 3 and then one end marker per run,
    about one per micro-batch; rows are up to two slices late."""
    events = table(spark, sf, "events")
    us = epoch_micros(F.col("ts"))
    span = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    src, width = scratch_path(spark, "step-events"), ((span["hi"] or 0) - (span["lo"] or 0)) // 4 + 1
    slice_of = F.floor((us - F.lit(span["lo"] or 0)) / F.lit(width))
    for arrival, part in enumerate((1, 0, 3, 2)):
        events.filter(slice_of == part).write.parquet(f"{src}/{arrival}")
    ends = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    schema = events.schema
    ends.select(*[F.col(f.name) if f.name in ("user_id", "ts") else F.lit(None).cast(f.dataType).alias(f.name)
                  for f in schema.fields]).write.parquet(f"{src}/4")
    steps = runs.step_stream(spark, f"{src}/*/*.parquet", schema, max_files=_arrival_files(spark, src, schema))
    out, ck = scratch_path(spark, "step-times-stream"), scratch_path(spark, "step-times-ckpt")
    runs.run_to_table(runs.step_times_stream(steps, 2 * width / 1e6), out, ck, "append")
    return round_doubles(runs.read_table(spark, out))


@register("step_times_timers", with_views(
    f"select run_id, step, loss, round({STEP_TIME_SQL}, 6) as step_time_ms from steps", "steps"))
def step_times_timers(spark, sf):
    """Step times with event-time timers.  The events arrive as four slices of
    time in the order 2, 1, 4, 3, about one per micro-batch, without any end
    marker of a run; one heartbeat ends the log."""
    events = table(spark, sf, "events")
    us = epoch_micros(F.col("ts"))
    span = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    src, width = scratch_path(spark, "timer-events"), (hi - lo) // 4 + 1
    for arrival, part in enumerate((1, 0, 3, 2)):
        events.filter(F.floor((us - F.lit(lo)) / F.lit(width)) == part).write.parquet(f"{src}/{arrival}")
    # lateness: two slices; a run is over when it is silent for the whole span
    beat = F.timestamp_micros(F.lit(hi + 8 * width)).cast(events.schema["ts"].dataType)
    spark.range(1).select(*[beat.alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.parquet(f"{src}/4")
    steps = runs.step_stream(spark, f"{src}/*/*.parquet", events.schema, max_files=_arrival_files(spark, src, events.schema))
    out, ck = scratch_path(spark, "step-timers"), scratch_path(spark, "step-timers-ckpt")
    with timers.with_rocksdb(spark):
        runs.run_to_table(timers.step_times_timers(steps, 2 * width / 1e6, 4 * width / 1e6), out, ck, "append")
    return round_doubles(runs.read_table(spark, out))

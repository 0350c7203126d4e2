"""Registered queries: evaluation reports and training-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import logs, report
from ..sources import derived
from ..sources.tables import table
from ..functions.text import PY_SPACE
from .oracle import with_views
from .registry import register

BASELINE = "AF"
CONFIGURED_METHODS = ["AF", "AO", "NF", "NO", "RF", "RO", "ZZ"]  # the last has no results


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (stable comparison across engines)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def summary_df(spark, sf):
    return report.report_summary(derived.samples(spark, sf))


THROUGHPUT_SQL = "case when latency > 0 then num_tokens / latency else 0.0 end"

SUMMARY_SQL = f"""
    select method, count(*) as total_samples, coalesce(sum(num_tokens), 0)::bigint as total_tokens,
           coalesce(avg(num_tokens), 0.0) as avg_tokens_per_sample,
           coalesce(avg(latency), 0.0) as avg_latency_seconds,
           coalesce(quantile_cont(latency, 0.95), 0.0) as p95_latency_seconds,
           coalesce(avg({THROUGHPUT_SQL}), 0.0) as avg_throughput_tokens_per_sec,
           coalesce(avg(cpu_percent), 0.0) as avg_cpu_percent,
           coalesce(avg(memory_percent), 0.0) as avg_memory_percent,
           coalesce(avg(gpu_memory_mb), 0.0) as avg_gpu_memory_mb,
           coalesce(avg(rouge1_f1), 0.0) as rouge1_f1, coalesce(avg(rouge2_f1), 0.0) as rouge2_f1,
           coalesce(avg(rougeL_f1), 0.0) as rougeL_f1, coalesce(avg(bleu_score), 0.0) as bleu_score
    from samples group by method"""


def _r(cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols.split())


@register("sample_throughput", with_views(
    f"select sample_id, method, round({THROUGHPUT_SQL}, 6) as throughput from samples", "samples"))
def sample_throughput(spark, sf):
    return round_doubles(report.sample_throughput(derived.samples(spark, sf))
                         .select("sample_id", "method", "throughput"))


@register("report_summary", with_views(
    "select method, total_samples, total_tokens, " + _r(
        "avg_tokens_per_sample avg_latency_seconds p95_latency_seconds avg_throughput_tokens_per_sec "
        "avg_cpu_percent avg_memory_percent avg_gpu_memory_mb rouge1_f1 rouge2_f1 rougeL_f1 bleu_score")
    + " from s", "samples", extra={"s": SUMMARY_SQL}))
def report_summary(spark, sf):
    return round_doubles(summary_df(spark, sf))


@register("baseline_compare", with_views(f"""
    select s.method, b.method as baseline,
           round(case when s.avg_latency_seconds > 0 and b.avg_latency_seconds > 0
                      then b.avg_latency_seconds / s.avg_latency_seconds end, 6) as latency_speedup,
           round(case when b.avg_throughput_tokens_per_sec > 0
                      then (s.avg_throughput_tokens_per_sec / b.avg_throughput_tokens_per_sec - 1) * 100 end, 6)
               as throughput_gain_pct,
           round(s.rouge1_f1 - b.rouge1_f1, 6) as rouge1_delta,
           round(s.bleu_score - b.bleu_score, 6) as bleu_delta
    from s, (select * from s where method = '{BASELINE}') b""", "samples", extra={"s": SUMMARY_SQL}))
def baseline_compare(spark, sf):
    return round_doubles(report.baseline_compare(summary_df(spark, sf), BASELINE))


@register("cross_method", with_views("""
    select method, round(rouge1_f1, 4) as rouge_1, round(rouge2_f1, 4) as rouge_2,
           round(rougeL_f1, 4) as rouge_l, round(bleu_score, 4) as bleu,
           round(avg_latency_seconds * 1000, 4) as latency_ms,
           round(avg_throughput_tokens_per_sec, 4) as throughput_tok_s,
           round(avg_gpu_memory_mb, 4) as gpu_mem_mb from s""", "samples", extra={"s": SUMMARY_SQL}))
def cross_method(spark, sf):
    return report.cross_method(summary_df(spark, sf))


@register("memory_reduction", with_views(f"""
    select method as config, round(avg_gpu_memory_mb, 1) as peak_mb,
           round(100 * (1 - round(avg_gpu_memory_mb, 1)
                 / greatest((select round(avg_gpu_memory_mb, 1) from s where method = '{BASELINE}'), 1.0)), 1)
               as reduction_pct
    from s""", "samples", extra={"s": SUMMARY_SQL}))
def memory_reduction(spark, sf):
    return report.memory_reduction(summary_df(spark, sf), "method", "avg_gpu_memory_mb", BASELINE)


@register("response_words", f"""
    select conv_id, turn, len(list_filter(regexp_split_to_array(text, '[{PY_SPACE}]+'), lambda w: w <> ''))::integer
        as num_tokens
    from conversations where role = 'assistant'""")
def response_words(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return report.response_words(c, "text").select("conv_id", "turn", "num_tokens")


@register("pair_by_id", """
    select r.idx, r.reference, h.hypothesis
    from (select conv_id*1000+turn as idx, text as reference from conversations where role = 'user') r
    join (select conv_id*1000+turn-1 as idx, text as hypothesis from conversations where role = 'assistant') h
    using (idx)""")
def pair_by_id(spark, sf):
    c = table(spark, sf, "conversations")
    refs = c.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("reference"))
    hyps = c.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("idx"), F.col("text").alias("hypothesis"))
    return report.pair_by_id(refs, hyps, "idx")


def _configured(spark):
    return spark.createDataFrame([(m,) for m in CONFIGURED_METHODS], "method string")


_CONFIGURED_SQL = "(select unnest([" + ", ".join(f"'{m}'" for m in CONFIGURED_METHODS) + "]) as method)"


@register("methods_present", with_views(
    f"select method from {_CONFIGURED_SQL} c where method in (select method from samples)", "samples"))
def methods_present(spark, sf):
    return report.methods_present(_configured(spark), derived.samples(spark, sf))


@register("methods_missing", with_views(
    f"select method from {_CONFIGURED_SQL} c where method not in (select method from samples)", "samples"))
def methods_missing(spark, sf):
    return report.methods_missing(_configured(spark), derived.samples(spark, sf))


@register("record_rouge", """
    select l_orderkey * 10 + l_linenumber as sample_id,
           case when l_discount > 0 then l_discount * 10 end as rouge1_f1,
           case when l_discount > 0 then case when l_tax > 0 then l_tax * 10 else 0.0 end end as rouge2_f1,
           case when l_discount > 0 then 0.0::double end as "rougeL_f1"
    from lineitem""")
def record_rouge(spark, sf):
    """Scores given as a map: absent for some samples, without one key for
    others, and never with the third."""
    li = table(spark, sf, "lineitem")
    one, two = F.map_from_arrays(F.array(F.lit("rouge1_f1")), F.array(F.col("l_discount") * 10)), F.create_map(
        F.lit("rouge1_f1"), F.col("l_discount") * 10, F.lit("rouge2_f1"), F.col("l_tax") * 10)
    scores = F.when(F.col("l_discount") > 0, F.when(F.col("l_tax") > 0, two).otherwise(one))
    return report.record_rouge(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), scores.alias("rouge")))


STEP_TIME_SQL = """coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by run_id order by ts, step))
                            / 1000.0, 0.0)"""


@register("step_times", with_views(
    f"select run_id, step, loss, round({STEP_TIME_SQL}, 6) as step_time_ms from steps", "steps"))
def step_times(spark, sf):
    return round_doubles(logs.step_times(derived.steps(spark, sf))
                         .select("run_id", "step", "loss", "step_time_ms"))


RUN_SUMMARY_SQL = """
    select run_id, count(*) as total_steps,
           round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) as total_time_s,
           round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000.0 / count(*), 6) as avg_step_time_ms,
           round(max(memory_gb), 6) as peak_memory_gb,
           round(max(coalesce(gpu_memory_mb, 0.0)), 6) as peak_gpu_memory_mb,
           round(arg_max(loss, (ts, step)), 6) as final_loss
    from steps group by run_id"""


@register("run_summary", with_views(RUN_SUMMARY_SQL, "steps"))
def run_summary(spark, sf):
    return round_doubles(logs.run_summary(derived.steps(spark, sf)))


@register("best_checkpoint", with_views("""
    select run_id, step, any_value(loss) as loss, bool_or(is_best) as is_best, bool_or(is_recent) as is_recent
    from (select run_id, step, loss, row_number() over (partition by run_id order by loss, step) = 1 as is_best,
                 row_number() over (partition by run_id order by step desc) <= 2 as is_recent from steps)
    where is_best or is_recent group by run_id, step""", "steps"))
def best_checkpoint(spark, sf):
    return logs.best_checkpoint(derived.steps(spark, sf), save_total_limit=2)

"""Evaluation-report analytics over a long ``samples`` table (one row per
generated answer, ``method`` a column): per-sample throughput, per-method
summaries, baseline comparison, cross-method table, memory reduction,
word counts, positional pairing and method availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import whitespace_word_count
from .quantile import exact_percentile

SUMMARY_COLUMNS = [
    "method", "total_samples", "total_tokens", "avg_tokens_per_sample", "avg_latency_seconds",
    "p95_latency_seconds", "avg_throughput_tokens_per_sec", "avg_cpu_percent", "avg_memory_percent",
    "avg_gpu_memory_mb", "rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu_score",
]


def sample_throughput(samples: DataFrame) -> DataFrame:
    """``throughput = num_tokens / latency``, 0 when latency <= 0."""
    return samples.withColumn(
        "throughput",
        F.when(F.col("latency") > 0, F.col("num_tokens") / F.col("latency")).otherwise(F.lit(0.0)))


def record_rouge(df: DataFrame, scores: str = "rouge") -> DataFrame:
    """Score columns from a map of scores: no or an empty map means "not recorded" (NULL,
    left out of the means), a map without a key counts as 0.0."""
    pick = lambda k: F.when(F.size(F.coalesce(scores, F.create_map().cast("map<string,double>"))) > 0, F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)))
    return df.select("*", *[pick(k).alias(k) for k in ("rouge1_f1", "rouge2_f1", "rougeL_f1")]).drop(scores)


def _mean(c: str):
    # mean over recorded values; an empty list reports 0.0
    return F.coalesce(F.avg(c), F.lit(0.0))


def report_summary(samples: DataFrame, p95: str = "exact") -> DataFrame:
    """Per-method summary (14 fields).  Mean throughput is the mean of
    per-sample ratios.  NULL GPU/ROUGE/BLEU values are "not recorded".

    ``p95="exact"`` gives the interpolated 95th percentile with bounded
    per-task memory (see :mod:`.quantile`); ``"approx"`` uses one sketch.  Only
    a method without any latency reports 0.0.
    """
    s = sample_throughput(samples)
    aggs = [
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.sum("num_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        _mean("num_tokens").alias("avg_tokens_per_sample"),
        _mean("latency").alias("avg_latency_seconds"),
        _mean("throughput").alias("avg_throughput_tokens_per_sec"),
        _mean("cpu_percent").alias("avg_cpu_percent"),
        _mean("memory_percent").alias("avg_memory_percent"),
        _mean("gpu_memory_mb").alias("avg_gpu_memory_mb"),
        _mean("rouge1_f1").alias("rouge1_f1"),
        _mean("rouge2_f1").alias("rouge2_f1"),
        _mean("rougeL_f1").alias("rougeL_f1"),
        _mean("bleu_score").alias("bleu_score"),
    ]
    if p95 == "exact":
        agg = exact_percentile(s, ["method"], "latency", 0.95, out="p95_latency_seconds", extra_aggs=aggs)
    else:
        agg = s.groupBy("method").agg(
            *aggs, F.percentile_approx("latency", 0.95, 100_000).cast("double").alias("p95_latency_seconds"))
    return agg.withColumn("p95_latency_seconds", F.coalesce("p95_latency_seconds", F.lit(0.0))) \
              .select(*SUMMARY_COLUMNS)


def _baseline(col: str, baseline: str) -> Column:
    """The baseline method's value of ``col`` on every row.  The summary has
    one row per method, so this unpartitioned window is over a handful of
    rows, and the summary is computed once (no self-join)."""
    return F.first(F.when(F.col("method") == baseline, F.col(col)), ignorenulls=True).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def baseline_compare(summary: DataFrame, baseline: str) -> DataFrame:
    """Each method against the named baseline: latency speedup (both > 0,
    else NULL), throughput gain % (baseline > 0, else NULL), ROUGE-1 and
    BLEU deltas.  No row when the baseline is absent."""
    j = summary.select(
        "*", _baseline("method", baseline).alias("baseline"),
        _baseline("avg_latency_seconds", baseline).alias("b_lat"),
        _baseline("avg_throughput_tokens_per_sec", baseline).alias("b_thr"),
        _baseline("rouge1_f1", baseline).alias("b_r1"), _baseline("bleu_score", baseline).alias("b_bleu"))
    return j.filter(F.col("baseline").isNotNull()).select(
        "method", "baseline",
        F.when((F.col("avg_latency_seconds") > 0) & (F.col("b_lat") > 0),
               F.col("b_lat") / F.col("avg_latency_seconds")).alias("latency_speedup"),
        F.when(F.col("b_thr") > 0,
               (F.col("avg_throughput_tokens_per_sec") / F.col("b_thr") - 1) * 100).alias("throughput_gain_pct"),
        (F.col("rouge1_f1") - F.col("b_r1")).alias("rouge1_delta"),
        (F.col("bleu_score") - F.col("b_bleu")).alias("bleu_delta"),
    )


def cross_method(summary: DataFrame) -> DataFrame:
    """Comparison table: 7 metrics per method, latency in ms, 4 decimals."""
    return summary.select(
        "method",
        F.round("rouge1_f1", 4).alias("rouge_1"),
        F.round("rouge2_f1", 4).alias("rouge_2"),
        F.round("rougeL_f1", 4).alias("rouge_l"),
        F.round("bleu_score", 4).alias("bleu"),
        F.round(F.col("avg_latency_seconds") * 1000, 4).alias("latency_ms"),
        F.round("avg_throughput_tokens_per_sec", 4).alias("throughput_tok_s"),
        F.round("avg_gpu_memory_mb", 4).alias("gpu_mem_mb"),
    )


def memory_reduction(df: DataFrame, config: str, value: str, baseline: str) -> DataFrame:
    """Value rounded to 1 decimal first, then
    ``round(100 * (1 - v / max(baseline_v, 1)), 1)``; the baseline is named
    (absent: the reduction is NULL).  ``df`` is one row per configuration (a small table)."""
    rounded = df.select(F.col(config).alias("method"), F.round(F.col(value), 1).alias("peak_mb"))
    base = _baseline("peak_mb", baseline)
    return rounded.select(F.col("method").alias("config"), "peak_mb",
                          F.when(base.isNotNull(), F.round(100 * (1 - F.col("peak_mb") / F.greatest(base, F.lit(1.0))), 1))
                           .alias("reduction_pct"))


def response_words(df: DataFrame, text: str, out: str = "num_tokens") -> DataFrame:
    """Whitespace word count of a response, used as its token count."""
    return df.withColumn(out, whitespace_word_count(F.col(text)))


def pair_by_id(references: DataFrame, hypotheses: DataFrame, key: str = "idx") -> DataFrame:
    """Pair references with hypotheses on an explicit id (inner: unmatched
    ids on either side drop out, like ``zip`` truncation)."""
    return references.join(hypotheses, key, "inner")


def methods_present(configured: DataFrame, samples: DataFrame) -> DataFrame:
    """Configured methods that have results."""
    return configured.join(samples.select("method").distinct(), "method", "left_semi")


def methods_missing(configured: DataFrame, samples: DataFrame) -> DataFrame:
    """Configured methods with no results (the skip report)."""
    return configured.join(samples.select("method").distinct(), "method", "left_anti")

"""End-to-end evaluation: stored responses -> scoring -> samples table ->
per-method report.  Methods are a column, so every method is scored in the
same jobs.  Responses come from :func:`..operators.generate.batch_generate`
with a user's models, or from any other table of that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, prep, report
from ..session import materialize

TIMINGS = ("latency", "num_tokens", "cpu_percent", "memory_percent", "gpu_memory_mb")


def prompt_table(test: DataFrame) -> DataFrame:
    """``idx, prompt, reference, question`` from a test split; ``idx`` is the
    md5 of title and answer (equal pairs are one prompt)."""
    keyed = test.withColumn("idx", F.md5(F.concat_ws("\u0001", "question_title", "answer")))
    return prep.render_prompt(keyed).select("idx", "prompt", F.col("answer").alias("reference"),
                                            F.col("question_title").alias("question"))


def score_responses(responses: DataFrame) -> DataFrame:
    """Samples table from ``method, idx, reference, response`` and the recorded
    :data:`TIMINGS`: one row per response with its four scores."""
    pairs = responses.select("method", "idx", "reference", F.col("response").alias("hypothesis"), *TIMINGS)
    # the samples table feeds several report passes: written once
    return materialize(metrics.per_sample_scores(pairs).withColumnRenamed("bleu", "bleu_score"), "samples")


def evaluation_report(responses: DataFrame) -> DataFrame:
    return report.report_summary(score_responses(responses))

"""Plan-shape checks: pushdown, pruning, top-k, exchange reuse, window
group limits, broadcast lookups."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuskit.operators import logs, prep, tokens
from corpuskit.operators.quantile import exact_percentile
from corpuskit.operators.split import grouped_split
from corpuskit.session import materialize
from corpuskit.sources import derived
from corpuskit.sources.tables import table


def _executed(df) -> str:
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()  # runs this plan, so the adaptive plan is final
    return qe.executedPlan().toString()


def test_score_filter_pushed_and_columns_pruned(spark):
    q = materialize(derived.questions(spark, SF_SMALL), "q-parquet")
    plan = prep.score_filter(q, 5).select("Id", "Score")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Score,5)" in plan
    assert "ReadSchema: struct<Id:bigint,Score:int>" in plan


def test_top_questions_is_take_ordered(spark):
    q = derived.questions(spark, SF_SMALL)
    plan = prep.top_questions(q, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_step_times_stays_in_jvm(spark):
    plan = _executed(logs.step_times(derived.steps(spark, SF_SMALL)))
    assert "Python" not in plan and "Pandas" not in plan and "rangepartitioning" not in plan


def test_split_is_narrow_after_the_count(spark):
    """The rows meet the two boundary keys, not a table of titles."""
    pairs = materialize(spark.range(500).select(F.concat(F.lit("t"), F.col("id") % 90).alias("question_title"), F.col("id").alias("answer")), "pairs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = grouped_split(pairs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_summary_shuffles_no_samples(spark):
    samples = materialize(derived.samples(spark, SF_SMALL), "samples")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = []
        plan = _executed(exact_percentile(samples, ["method"], "latency", 0.95))
        joins += [x for x in plan.splitlines() if "latency" in x and "Exchange" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not joins


def test_newest_checkpoints_use_window_group_limit(spark):
    plan = _executed(logs.best_checkpoint(derived.steps(spark, SF_SMALL)))
    assert "WindowGroupLimit" in plan


def test_run_summary_is_one_aggregate_no_window(spark):
    plan = _executed(logs.run_summary(derived.steps(spark, SF_SMALL)))
    assert "partial_max_by" in plan and "Window" not in plan


def test_encode_shuffles_no_tokens(spark):
    docs = table(spark, SF_SMALL, "documents")
    plan = _executed(tokens.encode(docs, "text", tokens.vocab(docs, "text", 100), ["doc_id"]))
    assert "Exchange" not in plan and "Join" not in plan


def test_scoring_shuffles_no_ngrams(spark):
    from corpuskit.operators import metrics

    pairs = materialize(derived.score_pairs(spark, SF_SMALL), "pairs")
    plan = _executed(metrics.per_sample_scores(pairs))
    assert "Exchange" not in plan and "Join" not in plan


def test_html_cleaning_stays_in_jvm(spark):
    from corpuskit.functions.html import html_to_text

    plan = _executed(table(spark, SF_SMALL, "pages").select(html_to_text(F.col("html")).alias("t")))
    assert "Python" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan

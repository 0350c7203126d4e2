"""Views derived from the test tables that stand in for the corpora the
operators are built for (a Q&A dump, evaluation samples, training logs,
stored logits, scoring pairs).  Each is a lazy DataFrame over the parquet
tables, so its size grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def _score(text):
    """A content-derived vote score: one point per 20 characters."""
    return F.floor(F.length(text) / F.lit(20.0)).cast("int")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions table ``Id, Title, Body, Score`` from the user turns.

    The title is the first sentence, padded with whitespace the trim must
    remove; the body is the whole turn as HTML.
    """
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    first_sentence = F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("Id"),
        F.concat(F.lit(" \t"), first_sentence, F.lit("\n ")).alias("Title"),
        F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>")).alias("Body"),
        _score(F.col("text")).alias("Score"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers table ``Id, ParentId, Body, Score`` from the assistant turns;
    the parent is the turn before."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    bolded = F.regexp_replace("text", r"^(\S+)", "<b>$1</b>")
    return c.select(
        (F.lit(1_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("Id"),
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("ParentId"),
        F.concat(F.lit("<div><p>"), F.replace(bolded, F.lit("\n"), F.lit("</p>\n<p>")),
                 F.lit("</p></div>")).alias("Body"),
        _score(F.col("text")).alias("Score"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation samples, one row per generated answer, from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
        F.concat("l_returnflag", "l_linestatus").alias("method"),
        F.col("l_quantity").cast("int").alias("num_tokens"),
        (F.col("l_extendedprice") / 10000.0).alias("latency"),
        (F.col("l_discount") * 100).alias("cpu_percent"),
        (F.col("l_tax") * 100).alias("memory_percent"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") * 64).alias("gpu_memory_mb"),
        (F.col("l_discount") * 10).alias("rouge1_f1"),
        (F.col("l_tax") * 10).alias("rouge2_f1"),
        ((F.col("l_discount") + F.col("l_tax")) * 5).alias("rougeL_f1"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double"))
         .otherwise(F.col("l_discount") * F.col("l_tax") * 100).alias("bleu_score"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-step log from ``events``: one run per user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.col("ts"),
        F.col("value").alias("loss"),
        (F.get_json_object("props", "$.k").cast("double") / 10.0).alias("memory_gb"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value") * 100).alias("gpu_memory_mb"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored student/teacher logits: a vector is a student row, the next
    vector its teacher; 16 positions per sample; label 0 is masked."""
    e = table(spark, sf_dir, "embeddings")
    t = e.select(F.col("vec_id").alias("t_id"), F.col("embedding").alias("teacher"))
    return (e.join(t, F.col("t_id") == F.col("vec_id") + 1, "inner")
             .select(F.floor(F.col("vec_id") / 16).cast("long").alias("sample_id"),
                     (F.col("vec_id") % 16).cast("int").alias("pos"),
                     F.col("embedding").alias("student"), "teacher",
                     F.when(F.col("label") == 0, F.lit(-100)).otherwise(F.col("label")).alias("label")))


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference/hypothesis pairs: a turn against the same turn of the next
    conversation."""
    c = table(spark, sf_dir, "conversations")
    h = c.select(F.col("conv_id").alias("h_conv"), F.col("turn").alias("h_turn"),
                 F.col("text").alias("hypothesis"))
    return (c.join(h, (F.col("h_conv") == F.col("conv_id") + 1) & (F.col("h_turn") == F.col("turn")))
             .select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
                     F.col("text").alias("reference"), "hypothesis"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector table (``vec_id, v``) for quantization and norm clipping."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))

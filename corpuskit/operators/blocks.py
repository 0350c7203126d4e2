"""Distillation loss over logits that are stored in vocabulary blocks.

A large model's logits of one position do not fit a row well, and teacher and
student are often written by different jobs: each is a table with one row per
(sample, position, block) that holds the logits of ``size`` consecutive
vocabulary entries.  The two tables are joined by block, so no position's whole
vocabulary ever meets in a row.  Every block gives a partial sum of softmax
terms against its own maximum; partial sums merge exactly:

    (m, z) + (m', z') = (M, z exp(m - M) + z' exp(m' - M)),  M = max(m, m')

Merging goes in two grouped steps, each combined before the shuffle: the
largest value of a position, then sums scaled to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["sample_id", "pos"]


def to_blocks(logits: DataFrame, values: str, size: int) -> DataFrame:
    """(sample_id, pos, block, values) from whole rows of logits."""
    v = F.col(values).cast("array<double>")
    starts = F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(size)).cast("int") - 1)
    cut = F.when(F.size(v) > 0, F.transform(starts, lambda b: F.struct(b.alias("block"), F.slice(v, b * size + 1, F.lit(size)).alias("values")))).otherwise(F.array().cast("array<struct<block:int,values:array<double>>>"))
    return logits.select(*KEYS, F.explode(cut).alias("b")).select(*KEYS, "b.block", "b.values")


def _scaled(values: Column, k: Column, top: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v * k - top))


def block_sums(student: DataFrame, teacher: DataFrame, temperature: float) -> DataFrame:
    """One row per block of both tables: the block's maxima (m_*), sums scaled
    to them (z_*) and the teacher-weighted difference (cross)."""
    k = F.lit(1.0 / float(temperature))
    s, t = student.withColumnRenamed("values", "s"), teacher.withColumnRenamed("values", "t")
    # a block that one side lacks, or of another length, is an error, not a truncation
    both = s.join(t, [*KEYS, "block"], "full")
    size = F.when(F.size("s") == F.size("t"), F.size("s")).otherwise(F.raise_error(F.lit("student and teacher blocks differ")).cast("int"))
    both = both.withColumn("n", F.coalesce(size, F.raise_error(F.lit("a block of student or teacher is missing")).cast("int")))
    both = both.withColumn("m_s", F.array_max("s")).withColumn("m_t", F.array_max("t"))
    cross = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda acc, i: acc + F.exp((F.element_at("t", i) - F.col("m_t")) * k) * (F.element_at("t", i) - F.element_at("s", i)))
    return both.select(*KEYS, "block", "m_s", "m_t", _scaled(F.col("s"), k, F.col("m_s") * k).alias("z_s"), _scaled(F.col("t"), k, F.col("m_t") * k).alias("z_t"),
                       _scaled(F.col("s"), F.lit(1.0), F.col("m_s")).alias("z_1"), cross.alias("cross"))


def merged(sums: DataFrame, keys: list[str], temperature: float) -> DataFrame:
    """The same columns for whole groups of blocks (of a position, or of any
    coarser block: merging merged rows gives the same)."""
    k = F.lit(1.0 / float(temperature))
    tops = sums.groupBy(*keys).agg(F.max("m_s").alias("_s"), F.max("m_t").alias("_t"))
    scaled = sums.join(tops, keys)
    to_s, to_t = F.exp((F.col("m_s") - F.col("_s")) * k), F.exp((F.col("m_t") - F.col("_t")) * k)
    return scaled.groupBy(*keys).agg(F.max("_s").alias("m_s"), F.max("_t").alias("m_t"), F.sum(F.col("z_s") * to_s).alias("z_s"), F.sum(F.col("z_t") * to_t).alias("z_t"),
                                     F.sum(F.col("z_1") * F.exp(F.col("m_s") - F.col("_s"))).alias("z_1"), F.sum(F.col("cross") * to_t).alias("cross"))


def distill_loss_blocks(student: DataFrame, teacher: DataFrame, labels: DataFrame, size: int, temperature: float = 2.0, alpha: float = 0.5) -> DataFrame:
    """The row of :func:`vectors.distill_loss` from two block tables and
    labels (sample_id, pos, label); -100 and null are masked.  Blocks of masked
    positions are dropped before any sum.  ``size`` is the number of vocabulary
    entries per block (the last one may be short)."""
    valid = labels.where(F.col("label").isNotNull() & (F.col("label") != -100)).select(*KEYS, "label")
    s, t = student.join(valid.select(*KEYS), KEYS, "left_semi"), teacher.join(valid.select(*KEYS), KEYS, "left_semi")
    whole = merged(block_sums(s, t, temperature), KEYS, temperature)
    # the label's own logit lies in one block of the student
    own = valid.withColumn("block", F.floor(F.col("label") / size).cast("int")).join(student, [*KEYS, "block"])
    own = own.select(*KEYS, F.element_at("values", (F.col("label") % size + 1).cast("int")).alias("at_label"))
    k = 1.0 / float(temperature)
    lse = lambda m, z, f: F.col(m) * f + F.log(z)
    terms = whole.join(own, KEYS).select((F.col("cross") / F.col("z_t") * k - lse("m_t", "z_t", k) + lse("m_s", "z_s", k)).alias("kl"), (lse("m_s", "z_1", 1.0) - F.col("at_label")).alias("ce"))
    agg = terms.agg(F.count(F.lit(1)).alias("valid_positions"), F.coalesce(F.sum("kl"), F.lit(0.0)).alias("kl"), F.coalesce(F.sum("ce"), F.lit(0.0)).alias("ce"))
    denom = F.greatest(F.col("valid_positions"), F.lit(1))
    kl, ce = F.col("kl") / denom * float(temperature) ** 2, F.col("ce") / denom
    return agg.select("valid_positions", kl.alias("kl_loss"), ce.alias("ce_loss"), ((1 - alpha) * ce + alpha * kl).alias("total_loss"), F.exp(ce).alias("perplexity"))

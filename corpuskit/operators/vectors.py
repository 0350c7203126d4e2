"""Vector-table arithmetic: distillation loss over stored logits, the
temperature sweep, block-wise quantization and global-norm clipping.

Every operator is row-local array arithmetic (``transform``/``aggregate``)
plus ordinary aggregates; scalars that steer a second pass (a global norm)
stay in a one-row DataFrame joined by broadcast, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def with_log_softmax(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out`` = log-softmax of the double array ``src`` (max-shifted).

    Built in stages (max, log-sum-exp, result) so each intermediate is a
    column evaluated once per row, not an expression re-evaluated inside
    every lambda call.
    """
    df = with_logsumexp(df, src, f"__{out}_lse")
    return df.withColumn(out, F.transform(src, lambda v: v - F.col(f"__{out}_lse"))).drop(f"__{out}_lse")


def with_logsumexp(df: DataFrame, src: str, out: str, scale: Column | None = None) -> DataFrame:
    """Add ``out`` = log(sum(exp(x * scale))) of an array, max-shifted."""
    k = scale if scale is not None else F.lit(1.0)
    m = f"__{out}_m"
    df = df.withColumn(m, F.array_max(src) * k)
    return df.withColumn(out, F.col(m) + F.log(F.aggregate(
        src, F.lit(0.0), lambda acc, v: acc + F.exp(v * k - F.col(m))))).drop(m)


def distill_terms(logits: DataFrame, temperature: Column | float = 2.0, shift: bool = False) -> DataFrame:
    """Per valid position: ``kl`` = KL(teacher || student) on log-softmax of
    logits / T, and ``ce`` = student cross-entropy of the label (T = 1).
    Positions labelled -100 are dropped.  ``shift=True`` takes the label of
    the next position of the sample, as a causal LM loss does.

    With p = softmax(t/T): KL = sum(p * (t - s)) / T - lse(t/T) + lse(s/T)
    (since sum(p) = 1), and CE = lse(s) - s[label]; so each row needs only a
    few passes over its arrays and no intermediate arrays.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    df = logits
    if shift:
        df = df.withColumn("label", F.lead("label").over(Window.partitionBy("sample_id").orderBy("pos")))
    df = df.filter(F.col("label").isNotNull() & (F.col("label") != -100))
    df = (df.withColumn("__k", 1.0 / t)
            .withColumn("__s", F.col("student").cast("array<double>"))
            .withColumn("__t", F.col("teacher").cast("array<double>")))
    df = with_logsumexp(df, "__s", "__lse_sT", F.col("__k"))
    df = with_logsumexp(df, "__t", "__lse_tT", F.col("__k"))
    df = with_logsumexp(df, "__s", "__lse_s")
    k = F.col("__k")
    # both sides score the same vocabulary; anything else is an error, not a truncation
    n = F.when(F.size("__s") == F.size("__t"), F.size("__s")).otherwise(
        F.raise_error(F.lit("student and teacher logits differ in length")).cast("int"))
    cross = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + F.exp(
        F.element_at("__t", i) * k - F.col("__lse_tT")) * (F.element_at("__t", i) - F.element_at("__s", i)))
    kl = cross * k - F.col("__lse_tT") + F.col("__lse_sT")
    ce = F.col("__lse_s") - F.element_at("__s", F.col("label") + 1)
    return (df.withColumn("kl", kl).withColumn("ce", ce)
              .drop("__k", "__s", "__t", "__lse_sT", "__lse_tT", "__lse_s"))


def distill_loss(logits: DataFrame, temperature: float = 2.0, alpha: float = 0.5, shift: bool = False,
                 group_cols: list[str] | None = None) -> DataFrame:
    """``(1 - alpha) * CE + alpha * T^2 * mean KL`` over valid positions
    (denominator max(valid, 1)); also perplexity = exp(CE)."""
    g = group_cols or []
    terms = distill_terms(logits, temperature, shift)
    t2 = float(temperature) ** 2
    agg = terms.groupBy(*g).agg(F.count(F.lit(1)).alias("valid_positions"),
                                F.sum("kl").alias("__kl"), F.sum("ce").alias("__ce"))
    denom = F.greatest(F.col("valid_positions"), F.lit(1))
    kl = F.coalesce(F.col("__kl"), F.lit(0.0)) / denom * t2
    ce = F.coalesce(F.col("__ce"), F.lit(0.0)) / denom
    return agg.select(*g, "valid_positions", kl.alias("kl_loss"), ce.alias("ce_loss"),
                      ((1 - alpha) * ce + alpha * kl).alias("total_loss"), F.exp(ce).alias("perplexity"))


def temperature_sweep(logits: DataFrame, temperatures: list[float] = (1.0, 2.0, 4.0),
                      alpha: float = 0.5) -> DataFrame:
    """One row per temperature: KL (x T^2), CE, total loss."""
    # every logits row once per setting (a handful), no join needed
    j = logits.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    terms = distill_terms(j, F.col("temperature"))
    agg = terms.groupBy("temperature").agg(F.count(F.lit(1)).alias("valid_positions"),
                                           F.sum("kl").alias("__kl"), F.sum("ce").alias("__ce"))
    denom = F.greatest(F.col("valid_positions"), F.lit(1))
    kl = F.col("__kl") / denom * F.col("temperature") * F.col("temperature")
    ce = F.col("__ce") / denom
    return agg.select("temperature", "valid_positions", kl.alias("kl_loss"), ce.alias("ce_loss"),
                      ((1 - alpha) * ce + alpha * kl).alias("total_loss"))


def global_norm_clip(vectors: DataFrame, col: str = "v", max_norm: float = 1.0, norm_type: float = 2.0,
                     error_if_nonfinite: bool = False) -> DataFrame:
    """Clip a whole table of vectors by their joint p-norm.

    Pass 1 aggregates the norm over all rows (one row); pass 2 scales each
    element by ``min(1, max_norm / (norm + 1e-6))``.  Output keeps every
    column, replaces ``col`` and adds ``total_norm`` (the pre-clip norm).
    """
    v = F.col(col).cast("array<double>")
    if norm_type == float("inf"):
        part = F.aggregate(v, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
        total = vectors.agg(F.coalesce(F.max(part), F.lit(0.0)).alias("total_norm"))
    else:
        p = float(norm_type)
        part = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x), p))
        total = vectors.agg(F.pow(F.coalesce(F.sum(part), F.lit(0.0)), 1.0 / p).alias("total_norm"))
    if error_if_nonfinite:
        bad = total.filter(F.isnan("total_norm") | (F.abs("total_norm") == float("inf"))).take(1)
        if bad:
            raise ValueError("the total norm is not finite")
    scale = F.lit(float(max_norm)) / (F.col("total_norm") + 1e-6)
    coef = F.when(F.isnan(scale), scale).otherwise(F.least(F.lit(1.0), scale))  # a NaN norm makes every value NaN
    out = vectors.crossJoin(F.broadcast(total))  # one row
    return out.withColumn(col, F.transform(v, lambda x: x * coef))

"""Registered queries: vector-table arithmetic over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, sweep, vectors
from ..sources import derived
from .oracle import VIEWS
from .queries_eval import round_doubles
from .registry import register

T, ALPHA = 2.0, 0.5
SWEEP = [1.0, 2.0, 4.0]


def _lsm(x: str) -> str:
    return (f"list_transform({x}, lambda v: v - (list_max({x}) + "
            f"ln(list_sum(list_transform({x}, lambda y: exp(y - list_max({x})))))))")


def _terms_sql(temp: str) -> str:
    """Rows (temperature, kl, ce) over valid positions of the logits view."""
    return f"""
    select temperature,
           list_sum(list_transform(range(1, len(lt) + 1), lambda i: exp(lt[i]) * (lt[i] - ls[i]))) as kl,
           -l1[label + 1] as ce
    from (select temperature, label, {_lsm('s')} as ls, {_lsm('t')} as lt, {_lsm('s1')} as l1
          from (select temperature, label,
                       list_transform(student::double[], lambda x: x / temperature) as s,
                       list_transform(teacher::double[], lambda x: x / temperature) as t,
                       student::double[] as s1
                from logits, ({temp}) where label <> -100))"""


DISTILL_SQL = f"""with logits as ({VIEWS['logits']})
    select count(*) as valid_positions,
           round(coalesce(sum(kl), 0) / greatest(count(*), 1) * {T * T}, 6) as kl_loss,
           round(coalesce(sum(ce), 0) / greatest(count(*), 1), 6) as ce_loss,
           round({1 - ALPHA} * coalesce(sum(ce), 0) / greatest(count(*), 1)
                 + {ALPHA} * coalesce(sum(kl), 0) / greatest(count(*), 1) * {T * T}, 6) as total_loss,
           round(exp(coalesce(sum(ce), 0) / greatest(count(*), 1)), 6) as perplexity
    from ({_terms_sql(f'select {T}::double as temperature')})"""

SWEEP_SQL = f"""with logits as ({VIEWS['logits']})
    select temperature, count(*) as valid_positions,
           round(sum(kl) / greatest(count(*), 1) * temperature * temperature, 6) as kl_loss,
           round(sum(ce) / greatest(count(*), 1), 6) as ce_loss,
           round({1 - ALPHA} * sum(ce) / greatest(count(*), 1)
                 + {ALPHA} * sum(kl) / greatest(count(*), 1) * temperature * temperature, 6) as total_loss
    from ({_terms_sql('select unnest([' + ', '.join(f'{t}::double' for t in SWEEP) + ']) as temperature')})
    group by temperature"""


@register("distill_loss", DISTILL_SQL)
def distill_loss(spark, sf):
    return round_doubles(vectors.distill_loss(derived.logits(spark, sf), T, ALPHA))


@register("distill_loss_blocks", DISTILL_SQL)
def distill_loss_blocks(spark, sf):
    """The same loss from two tables of vocabulary blocks (8 entries each, so
    that a position has several)."""
    logits = derived.logits(spark, sf)
    student, teacher = blocks.to_blocks(logits, "student", 8), blocks.to_blocks(logits, "teacher", 8)
    return round_doubles(blocks.distill_loss_blocks(student, teacher, logits.select("sample_id", "pos", "label"), 8, T, ALPHA))


@register("temperature_sweep", SWEEP_SQL)
def temperature_sweep(spark, sf):
    return round_doubles(vectors.temperature_sweep(derived.logits(spark, sf), SWEEP, ALPHA))


@register("global_norm_clip", """
    select vec_id, list_transform(v, lambda x: round(x * least(1.0, 1.0 / (n + 1e-6)), 6)) as v,
           round(n, 6) as total_norm
    from (select vec_id, embedding::double[] as v from embeddings),
         (select sqrt(sum(list_sum(list_transform(embedding::double[], lambda x: x * x)))) as n from embeddings)""")
def global_norm_clip(spark, sf):
    out = vectors.global_norm_clip(derived.vectors(spark, sf), max_norm=1.0)
    return out.select("vec_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"),
                      F.round("total_norm", 6).alias("total_norm"))


# A log of the sweep: samples are dealt out to steps of 4, every fifth is an
# evaluation sample, and the run of the highest temperature stops at four fifths.
SWEEP_LOG_SQL = f"""logits as ({VIEWS['logits']}),
    terms as ({_terms_sql('select unnest([' + ', '.join(f'{t}::double' for t in SWEEP) + ']) as temperature').replace('select temperature,', 'select temperature, sample_id,', 1)
               .replace('select temperature, label,', 'select temperature, sample_id, label,').replace('(select temperature, sample_id, label,', '(select temperature, sample_id, label,')}),
    log as (
      select temperature as setting, sample_id // 4 as step, case when sample_id % 5 = 0 then 'eval' else 'train' end as phase,
             {1 - ALPHA} * ce + {ALPHA} * temperature * temperature * kl as loss
      from terms where temperature < {SWEEP[-1]} or 5 * (sample_id // 4) < 4 * (select max(sample_id) // 4 from logits)),
    curve as (
      select setting, step, avg(loss) filter (phase = 'train') as train_loss, avg(loss) filter (phase = 'eval') as eval_loss from log group by all),
    common as (select max(step) as common_step from (select step from curve where eval_loss is not null group by step having count(*) = (select count(distinct setting) from log)))"""


def _sweep_log(spark, sf):
    logits = derived.logits(spark, sf).withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in SWEEP])))
    terms = vectors.distill_terms(logits, F.col("temperature"))
    step = F.floor(F.col("sample_id") / 4)
    last = derived.logits(spark, sf).agg(F.floor(F.max("sample_id") / 4).alias("__last"))
    loss = (1 - ALPHA) * F.col("ce") + ALPHA * F.col("temperature") * F.col("temperature") * F.col("kl")
    log = terms.select(F.col("temperature").alias("setting"), step.alias("step"), F.when(F.col("sample_id") % 5 == 0, "eval").otherwise("train").alias("phase"), loss.alias("loss"))
    return log.crossJoin(F.broadcast(last)).where((F.col("setting") < SWEEP[-1]) | (5 * F.col("step") < 4 * F.col("__last"))).drop("__last")  # one row


@register("sweep_table", f"""with {SWEEP_LOG_SQL}
    select setting, max(common_step) as common_step, round(avg(train_loss) filter (step <= common_step), 6) as train_loss,
           round(max(eval_loss) filter (step = common_step), 6) as eval_loss, round(min(eval_loss), 6) as best_eval_loss,
           arg_min(step, (eval_loss, step)) filter (eval_loss is not null) as best_eval_step
    from curve, common group by setting""")
def sweep_table(spark, sf):
    """Train and evaluation loss per temperature at the last common step."""
    return round_doubles(sweep.sweep_table(_sweep_log(spark, sf)))


@register("sweep_curves", f"""with {SWEEP_LOG_SQL}
    select step, """ + ", ".join(f"round(max({c}_loss) filter (setting = {t}), 6) as {c}_t{t:.0f}" for t in SWEEP for c in ("train", "eval")) + """
    from curve group by step""")
def sweep_curves(spark, sf):
    """Loss curves of all temperatures side by side, one row per step."""
    return round_doubles(sweep.wide_curves(_sweep_log(spark, sf), [(t, f"t{t:.0f}") for t in SWEEP]))

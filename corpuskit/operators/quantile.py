"""Exact linear-interpolated percentiles per group with bounded task memory.

Spark's exact ``percentile`` merges a map of every distinct value of a group
into one task, which does not survive a group holding a large share of the
rows.  Here the two order statistics are found by narrowing: each round counts
the rows of the current value range in ``BUCKETS`` equal parts (a partial,
map-side combined aggregate), keeps the part that holds the wanted rank, and
takes that part's least and greatest value as the next range.  A range whose
ends are equal is the answer.  Every group takes the same path, whatever its
size; no row is sorted or gathered, and the table of ranges has two rows per
group, joined by broadcast once its size was checked.  The result equals
NumPy's / DuckDB ``quantile_cont`` value.

Values are expected to be finite; NULL and NaN are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKETS = 4096
MAX_ROUNDS = 100          # a round divides the range by BUCKETS; doubles need far fewer
BROADCAST_GROUPS = 50_000


def exact_percentile(df: DataFrame, group_cols: list[str], value: str, p: float,
                     out: str = "percentile", extra_aggs: list[Column] = ()) -> DataFrame:
    """One row per group: ``group_cols..., *extra_aggs, out`` (``out`` NULL
    when the group has no value).  Raises if a rank is not found."""
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be within [0, 1]")
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    stats = materialize(df.groupBy(*group_cols).agg(
        *extra_aggs, F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max")), "percentile-groups")
    h = (F.col("__n") - 1) * F.lit(p)
    want = stats.filter(F.col("__n") > 0).select(
        *group_cols, F.explode(F.array(F.lit(0), F.lit(1))).alias("__k"), "__n", "__min", "__max", F.floor(h).cast("long").alias("__i"))
    # (group, which of the two ranks): rank within the range [lo, hi]
    ranges = materialize(want.select(*group_cols, "__k", F.least(F.col("__i") + F.col("__k"), F.col("__n") - 1).alias("__rank"),
                                     F.col("__min").alias("__lo"), F.col("__max").alias("__hi")), "percentile-ranges")
    few = ranges.count() <= BROADCAST_GROUPS
    vals = df.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group_cols)], v.alias("__v")).filter(F.col("__v").isNotNull())
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group_cols)]
    for _ in range(MAX_ROUNDS):
        unsettled = ranges.filter(F.col("__lo") < F.col("__hi"))
        if unsettled.isEmpty():
            break
        side = F.broadcast(unsettled) if few else unsettled
        inside = vals.join(side, [*same, F.col("__v").between(F.col("__lo"), F.col("__hi"))] if same else F.col("__v").between(F.col("__lo"), F.col("__hi")))
        share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)  # halves: no overflow
        part = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy(*group_cols, "__k", "__rank", part.alias("__part")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*group_cols, "__k").orderBy("__part")
                                              .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counted.withColumn("__before", before).filter(
            (F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
        narrowed = hit.select(*group_cols, "__k", (F.col("__rank") - F.col("__before")).alias("__rank"), "__lo", "__hi")
        settled = ranges.filter(F.col("__lo") >= F.col("__hi"))
        ranges = materialize(settled.unionByName(narrowed), "percentile-ranges")
    else:
        raise RuntimeError("a percentile was not found; are all values finite?")
    ends = ranges.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group_cols)]).agg(
        F.max(F.when(F.col("__k") == 0, F.col("__lo"))).alias("__xi"), F.max(F.when(F.col("__k") == 1, F.col("__lo"))).alias("__xj"))
    found = stats.join(ends, same, "left") if same else stats.crossJoin(ends)  # one row each
    exact = F.col("__xi") + (h - F.floor(h)) * (F.col("__xj") - F.col("__xi"))
    missed = (F.col("__n") > 0) & (F.col("__xi").isNull() | F.col("__xj").isNull())
    result = F.when(missed, F.raise_error(F.lit("percentile rank not found")).cast("double")).otherwise(exact)
    extra_cols = [c for c in stats.columns if c not in group_cols and not c.startswith("__")]
    return found.select(*group_cols, *extra_cols, result.alias(out))

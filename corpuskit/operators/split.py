"""Leakage-safe train/test/validation split grouped by question title.

Every pair of a title lands in one split.  Titles are ordered by
``md5(seed:title)`` (identical in Spark and DuckDB, reproducible across runs)
and cut at the exact sizes of a two-stage shuffle split:
``temp = ceil((test+val)*n)``, ``train = n - temp``,
``val = ceil(val/(test+val)*temp)``, ``test = temp - val``.

Exact cuts without a global sort: titles are counted per hash-prefix bucket
(at most ``2**bucket_bits`` rows), a running sum over that small table places
every bucket, and only titles of the (at most two) buckets a cut falls inside
are ranked, to find the last title before each cut.  Rows are then compared
with those two boundary keys, so the corpus is neither shuffled nor joined on
the title.  Rows without a title go where the empty title goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_key(title: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), title))


def split_sizes(n: int, test_size: float = 0.14, val_size: float = 0.06) -> tuple[int, int, int]:
    """(train, test, val) sizes for ``n`` titles (driver-side arithmetic)."""
    held = test_size + val_size
    n_temp = math.ceil(held * n)
    n_val = math.ceil(val_size / held * n_temp)
    return n - n_temp, n_temp - n_val, n_val


def distinct_titles(df: DataFrame, title: str = "question_title") -> DataFrame:
    return df.select(title).distinct()


def _bucket(key: Column, bucket_bits: int) -> Column:
    digits = bucket_bits // 4
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def grouped_split(df: DataFrame, *, title: str = "question_title", test_size: float = 0.14,
                  val_size: float = 0.06, seed: int = 42, bucket_bits: int = 16,
                  split_col: str = "split") -> DataFrame:
    """Add ``split`` in {train, test, val} to every row of ``df``."""
    if bucket_bits % 4 or not 4 <= bucket_bits <= 24:
        raise ValueError("bucket_bits must be a multiple of 4 in [4, 24]")
    held = test_size + val_size
    val_frac = val_size / held

    name = F.coalesce(F.col(title), F.lit(""))  # rows without a title follow the empty title
    titles = df.select(name.alias("__t")).distinct().withColumn("__key", title_key(F.col("__t"), seed)) \
               .withColumn("__bucket", _bucket(F.col("__key"), bucket_bits))

    # one row per non-empty bucket: bounded by 2**bucket_bits rows
    counts = titles.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__cnt"))
    ordered = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.sum("__cnt").over(everything)
    n_temp = F.ceil(F.lit(held) * n)
    n_val = F.ceil(F.lit(val_frac) * n_temp)
    buckets = (counts
               .withColumn("__start", F.coalesce(F.sum("__cnt").over(ordered), F.lit(0)))
               .withColumn("__c1", n - n_temp)
               .withColumn("__c2", n - n_val))
    end = F.col("__start") + F.col("__cnt")
    holds = lambda c: (F.col("__start") < F.col(c)) & (F.col(c) <= end)

    # the last title before each cut: only the (at most two) buckets that hold
    # a cut are ranked, and one row comes out
    ranked = (titles.join(F.broadcast(buckets.filter(holds("__c1") | holds("__c2"))), "__bucket")
              .withColumn("__rank", F.col("__start") + F.row_number().over(
                  Window.partitionBy("__bucket").orderBy("__key", "__t"))))
    at = F.struct("__key", "__t")
    cuts = ranked.agg(F.max(F.when(F.col("__rank") == F.col("__c1"), at)).alias("__b1"),
                      F.max(F.when(F.col("__rank") == F.col("__c2"), at)).alias("__b2"))

    # a narrow comparison with the two boundary keys: the rows are never joined on the title
    mine = F.struct(title_key(name, seed).alias("__key"), name.alias("__t"))
    up_to = lambda b: F.coalesce(mine <= F.col(b), F.lit(False))
    out = df.crossJoin(F.broadcast(cuts)).withColumn(
        split_col, F.when(up_to("__b1"), "train").when(up_to("__b2"), "test").otherwise("val"))
    return out.drop("__b1", "__b2")


def hash_split(df: DataFrame, *, title: str = "question_title", test_size: float = 0.14,
               val_size: float = 0.06, seed: int = 42, split_col: str = "split") -> DataFrame:
    """Approximate-size split with no count pass: the title hash, read as a
    fraction of 2**32, is compared with the cut fractions.  Narrow (no
    shuffle) and stable as the corpus grows."""
    frac = F.conv(F.substring(title_key(F.col(title), seed), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    train = 1.0 - (test_size + val_size)
    return df.withColumn(split_col, F.when(frac < train, "train")
                         .when(frac < train + test_size, "test").otherwise("val"))


def split_leakage(df: DataFrame, title: str = "question_title", split_col: str = "split") -> DataFrame:
    """Titles found in more than one split (must be empty)."""
    return (df.groupBy(title).agg(F.count_distinct(split_col).alias("n_splits"))
              .filter(F.col("n_splits") > 1))


def split_audit(df: DataFrame, title: str = "question_title", split_col: str = "split") -> DataFrame:
    """Per split: rows, distinct titles, and titles that also stand in another
    split.  Two grouped counts: a title is reduced to its splits before any
    row meets another, so a hot title is no hot key."""
    per = df.groupBy(title, split_col).agg(F.count(F.lit(1)).alias("rows"))
    several = per.groupBy(title).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(title, "__t")
    told = per.join(several, F.col(title).eqNullSafe(F.col("__t")))
    return told.groupBy(split_col).agg(F.sum("rows").alias("rows"), F.count(title).alias("titles"), F.count_if((F.col("__n") > 1) & F.col(title).isNotNull()).alias("leaking_titles"))

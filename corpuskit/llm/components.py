"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least reachable node of every linked node, from
    links (u, v) of longs.  Links are never gathered; every round is written
    to the shared folder, so a lost executor costs one round at most."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    now = materialize(links.where("u != v").select("u", "v").distinct(), "links")
    seen = state(now)
    while seen[0]:
        now = materialize(_small_star(_large_star(now)), "links")
        was, seen = seen, state(now)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

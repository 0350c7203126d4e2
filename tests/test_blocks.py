"""Distillation loss over vocabulary blocks."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import blocks, vectors

LOGITS = "sample_id long, pos int, student array<double>, teacher array<double>, label int"


def logits(spark, width, n=40, scale=5.0):
    rng = random.Random(width)
    row = lambda: [rng.gauss(0, scale) for _ in range(width)]
    return spark.createDataFrame([(i // 4, i % 4, row(), row(), rng.choice([-100, None, *range(width)])) for i in range(n)], LOGITS)


@pytest.mark.parametrize("width,size,temperature", [(13, 4, 2.0), (16, 4, 1.0), (7, 50, 3.0), (30, 1, 2.0)])
def test_blocks_give_the_loss_of_whole_rows(spark, width, size, temperature):
    df = logits(spark, width, scale=200.0)  # far apart: sums would overflow without the maxima
    got = blocks.distill_loss_blocks(blocks.to_blocks(df, "student", size), blocks.to_blocks(df, "teacher", size), df, size, temperature, 0.3).first()
    want = vectors.distill_loss(df, temperature, 0.3).first()
    for c in want.asDict():
        assert got[c] == pytest.approx(want[c], rel=1e-9), c


def test_merging_is_associative(spark):
    df = logits(spark, 24)
    sums = blocks.block_sums(blocks.to_blocks(df, "student", 3), blocks.to_blocks(df, "teacher", 3), 2.0)
    once = blocks.merged(sums, blocks.KEYS, 2.0)
    halves = blocks.merged(sums.withColumn("half", F.col("block") % 2), [*blocks.KEYS, "half"], 2.0)
    twice = {(r["sample_id"], r["pos"]): r for r in blocks.merged(halves, blocks.KEYS, 2.0).collect()}
    for r in once.collect():
        for c in ("m_s", "m_t", "z_s", "z_t", "z_1", "cross"):
            assert twice[r["sample_id"], r["pos"]][c] == pytest.approx(r[c], rel=1e-9)


def test_masked_empty_and_missing(spark):
    df = logits(spark, 8).withColumn("label", F.lit(-100))
    none = blocks.distill_loss_blocks(blocks.to_blocks(df, "student", 4), blocks.to_blocks(df, "teacher", 4), df, 4).first()
    assert none["valid_positions"] == 0 and none["total_loss"] == 0.0
    df = logits(spark, 8).withColumn("label", F.lit(1))
    lacking = blocks.to_blocks(df, "teacher", 4).where("block = 0")
    with pytest.raises(Exception, match="missing|differ"):
        blocks.distill_loss_blocks(blocks.to_blocks(df, "student", 4), lacking, df, 4).collect()

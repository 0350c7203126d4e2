import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import vectors

LOGITS = "sample_id long, pos int, student array<float>, teacher array<float>, label int"


def test_distill_golden(spark):
    df = spark.createDataFrame([(0, 0, [2.0, 0.0, 0.0], [1.0, 1.0, 0.0], 0),
                                (0, 1, [1.0, 2.0, 3.0], [0.0, 0.0, 1.0], -100)], LOGITS)
    r = vectors.distill_loss(df, 2.0, 0.5).first()
    assert r.valid_positions == 1
    assert r.kl_loss == pytest.approx(0.373699, abs=1e-6)
    assert r.ce_loss == pytest.approx(0.239545, abs=1e-6)
    assert r.total_loss == pytest.approx(0.306622, abs=1e-6)
    assert r.perplexity == pytest.approx(1.270671, abs=1e-6)


def test_distill_all_masked_and_sweep(spark):
    df = spark.createDataFrame([(0, 0, [2.0, 0.0], [1.0, 1.0], -100)], LOGITS)
    assert vectors.distill_loss(df).first().total_loss == 0.0
    df2 = spark.createDataFrame([(0, 0, [2.0, 0.0, 0.0], [1.0, 1.0, 0.0], 0)], LOGITS)
    sweep = {r.temperature: r.kl_loss for r in vectors.temperature_sweep(df2, [2.0]).collect()}
    assert sweep[2.0] == pytest.approx(0.373699, abs=1e-6)


def test_global_norm_clip_golden(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 12.0])], "vec_id long, v array<double>")
    rows = {r.vec_id: r for r in vectors.global_norm_clip(df, max_norm=1.0).collect()}
    assert rows[1].total_norm == pytest.approx(13.0)
    assert rows[1].v == pytest.approx([0.230769, 0.307692], abs=1e-6)
    assert rows[2].v == pytest.approx([0.0, 0.923077], abs=1e-6)


def test_global_norm_clip_property(spark):
    # the reference's test: random gradients x100, pre-norm > 1, post-norm <= 1 + 1e-5
    rng = np.random.default_rng(0)
    m = rng.normal(size=(10, 10)) * 100
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(10)], "vec_id long, v array<double>")
    out = vectors.global_norm_clip(df, max_norm=1.0)
    pre = out.first().total_norm
    post = np.sqrt(sum(float(np.sum(np.square(r.v))) for r in out.collect()))
    assert pre > 1.0 and post <= 1.0 + 1e-5
    inf = vectors.global_norm_clip(df, norm_type=float("inf")).first().total_norm
    assert inf == pytest.approx(float(np.abs(m).max()))


def test_nonfinite_norm_raises(spark):
    df = spark.createDataFrame([(1, [float("nan")])], "vec_id long, v array<double>")
    with pytest.raises(ValueError):
        vectors.global_norm_clip(df, error_if_nonfinite=True)
    assert df.select(F.lit(1)).count() == 1


def test_distill_shifted_labels(spark):
    # with shift=True the label of position p is the label stored at p + 1
    rows = [(0, 0, [2.0, 0.0, 0.0], [1.0, 1.0, 0.0], -100), (0, 1, [0.0, 0.0, 5.0], [0.0, 0.0, 1.0], 0),
            (0, 2, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, LOGITS)
    shifted = vectors.distill_loss(df, 2.0, 0.5, shift=True).first()
    aligned = vectors.distill_loss(spark.createDataFrame([(0, 0, [2.0, 0.0, 0.0], [1.0, 1.0, 0.0], 0),
                                                          (0, 1, [0.0, 0.0, 5.0], [0.0, 0.0, 1.0], 2)], LOGITS),
                                   2.0, 0.5).first()
    assert shifted.valid_positions == 2
    assert shifted.total_loss == pytest.approx(aligned.total_loss)


def test_logits_of_different_length_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0], 1)],
                               "sample_id long, pos int, student array<double>, teacher array<double>, label int")
    with pytest.raises(Exception, match="differ in length"):
        vectors.distill_loss(df).collect()


def test_nan_norm_clips_to_nan(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [float("nan"), 1.0])], "id long, v array<double>")
    for r in vectors.global_norm_clip(df, max_norm=1.0).collect():
        assert all(x != x for x in r.v) and r.total_norm != r.total_norm

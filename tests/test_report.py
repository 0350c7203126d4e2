import numpy as np
import pytest

from corpuskit.operators import report
from corpuskit.operators.quantile import exact_percentile

S_SCHEMA = ("method string, num_tokens int, latency double, cpu_percent double, memory_percent double, "
            "gpu_memory_mb double, rouge1_f1 double, rouge2_f1 double, rougeL_f1 double, bleu_score double")


def _samples(spark, rows):
    return spark.createDataFrame(rows, S_SCHEMA)


def test_throughput_mean_of_ratios(spark):
    s = _samples(spark, [("m", 10, 1.0, 1.0, 1.0, None, None, None, None, None),
                         ("m", 10, 4.0, 1.0, 1.0, None, None, None, None, None),
                         ("m", 5, 0.0, 1.0, 1.0, None, None, None, None, None)])
    assert [r.throughput for r in report.sample_throughput(s).collect()] == [10.0, 2.5, 0.0]
    row = report.report_summary(s).first()
    assert row.avg_throughput_tokens_per_sec == pytest.approx(12.5 / 3)
    assert row.total_tokens == 25 and row.total_samples == 3
    assert row.avg_gpu_memory_mb == 0.0 and row.rouge1_f1 == 0.0  # nothing recorded -> 0.0


def test_p95_linear_interpolation(spark):
    s = _samples(spark, [("m", 1, float(x), 0.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1) for x in (1, 2, 3, 10)])
    assert report.report_summary(s).first().p95_latency_seconds == pytest.approx(8.95)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_percentile_by_narrowing(spark, p):
    rng = np.random.default_rng(7)
    rows = ([("big", float(x)) for x in rng.normal(size=5000)]
            + [("dup", 3.0)] * 3000 + [("dup", float(x)) for x in rng.normal(size=50)]
            + [("small", float(x)) for x in (1, 2, 3, 10)]
            + [("wide", float(x)) for x in (-1e300, -1.0, 1e-300, 5e-300, 2.0, 1e300)] + [("small", None), ("small", float("nan"))])
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.percentile for r in exact_percentile(df, ["g"], "v", p).collect()}
    for g in ("big", "dup", "small", "wide"):
        vals = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12, rel=1e-12)


def test_baseline_compare_and_reduction(spark):
    s = _samples(spark, [("base", 10, 2.0, 0.0, 0.0, 2000.0, 0.2, 0.0, 0.0, 0.1),
                         ("fast", 10, 1.0, 0.0, 0.0, 1234.56, 0.3, 0.0, 0.0, 0.05),
                         ("zero", 10, 0.0, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0)])
    summ = report.report_summary(s)
    cmp = {r.method: r for r in report.baseline_compare(summ, "base").collect()}
    assert cmp["fast"].latency_speedup == pytest.approx(2.0)
    assert cmp["fast"].throughput_gain_pct == pytest.approx(100.0)
    assert cmp["fast"].rouge1_delta == pytest.approx(0.1)
    assert cmp["zero"].latency_speedup is None
    red = {r.config: r.reduction_pct for r in
           report.memory_reduction(summ, "method", "avg_gpu_memory_mb", "base").collect()}
    assert red == {"base": 0.0, "fast": 38.3, "zero": 100.0}


def test_response_words(spark):
    df = spark.createDataFrame([("a  b\tc\n",), ("",), (None,)], "t string")
    assert [r.num_tokens for r in report.response_words(df, "t").collect()] == [3, 0, 0]


def test_methods_present_missing(spark):
    conf = spark.createDataFrame([("a",), ("b",)], "method string")
    s = spark.createDataFrame([("a", 1)], "method string, x int")
    assert [r.method for r in report.methods_present(conf, s).collect()] == ["a"]
    assert [r.method for r in report.methods_missing(conf, s).collect()] == ["b"]


def test_p95_approx_option(spark):
    s = _samples(spark, [("m", 1, float(x), 0.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1) for x in range(1, 101)])
    exact = report.report_summary(s).first().p95_latency_seconds
    approx = report.report_summary(s, p95="approx").first().p95_latency_seconds
    assert exact == pytest.approx(float(np.percentile(range(1, 101), 95)))
    assert abs(approx - exact) <= 1.0


def test_reduction_without_its_baseline_is_null(spark):
    s = _samples(spark, [("a", 10, 2.0, 0.0, 0.0, 2000.0, 0.2, 0.0, 0.0, 0.1)])
    got = report.memory_reduction(report.report_summary(s), "method", "avg_gpu_memory_mb", "nobody").collect()
    assert [r.reduction_pct for r in got] == [None]


def test_rouge_maps_absent_empty_and_partial(spark):
    df = spark.sql("select 1 as id, map('rouge1_f1', 0.5D, 'rouge2_f1', 0.25D, 'rougeL_f1', 0.4D) as rouge union all "
                   "select 2, map('rouge1_f1', 0.3D) union all select 3, cast(null as map<string,double>) union all select 4, cast(map() as map<string,double>)")
    got = {r.id: (r.rouge1_f1, r.rouge2_f1, r.rougeL_f1) for r in report.record_rouge(df).collect()}
    assert got == {1: (0.5, 0.25, 0.4), 2: (0.3, 0.0, 0.0), 3: (None, None, None), 4: (None, None, None)}

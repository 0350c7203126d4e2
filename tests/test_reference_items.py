"""Resumable generation, observed checks, leakage audit, sweep tables."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import generate, prep, split, sweep
from corpuskit.session import scratch_path
from corpuskit.sources import files


def prompts(spark, n=60):
    return spark.createDataFrame([(i, f"prompt {i}", ("a", "b")[i % 2]) for i in range(n)], "idx long, prompt string, method string")


def answering(tag, fails_on=None):
    def factory():
        def model(texts):
            if fails_on in texts:
                raise RuntimeError("the model fails here")
            return [f"{tag} {t}" for t in texts]
        return model
    return factory


def test_generation_goes_on_where_it_failed(spark):
    ledger = scratch_path(spark, "ledger")
    with pytest.raises(Exception, match="the model fails here"):
        generate.resume_generate(prompts(spark), answering("first", "prompt 31"), ledger, waves=6, batch_size=4)
    held = generate.finished(spark, ledger, ["idx"])
    kept = {r["idx"] for r in held.collect()} if held is not None else set()
    assert 31 not in kept and len(kept) < 60
    got = generate.resume_generate(prompts(spark), answering("second"), ledger, waves=6, batch_size=4).collect()
    assert sorted(r["idx"] for r in got) == list(range(60))
    assert {r["idx"] for r in got if r["response"].startswith("first")} == kept and kept
    # all done: nothing is answered again, with any number of waves
    again = generate.resume_generate(prompts(spark), answering("third", "prompt 0"), ledger, waves=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_generation_ledger_per_method_and_bad_keys(spark):
    ledger = scratch_path(spark, "ledger")
    both = prompts(spark, 10).drop("method").crossJoin(spark.createDataFrame([("a",), ("b",)], "method string"))
    generate.resume_generate(both.where("method = 'a'"), {"a": answering("A")}, ledger, method="method", waves=2)
    got = generate.resume_generate(both, {"a": answering("X"), "b": answering("B")}, ledger, method="method", waves=2).collect()
    assert sorted((r["idx"], r["method"], r["response"][0]) for r in got) == [(i, m, m.upper()) for i in range(10) for m in "ab"]
    with pytest.raises(ValueError, match="without idx"):
        generate.resume_generate(spark.createDataFrame([(None, "p")], "idx long, prompt string"), answering("A"), scratch_path(spark, "ledger"))


def test_observed_figures_take_one_scan(spark):
    path = scratch_path(spark, "pages")
    spark.createDataFrame([("<p>" + "x" * n + "</p>", "x" * n) for n in (0, 10, 50, 51, 200)] + [("<b></b>", None)], "html string, text string").write.parquet(path)
    pages = spark.read.parquet(path)
    kept, seen = prep.observed_clean(pages, "html", "text", 50)
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert kept.count() == 2
    want = prep.clean_stats(pages, "html", "text", 50).first().asDict()
    assert seen.get == want


def test_observed_contract(spark):
    rows = lambda data: spark.createDataFrame(data, "prediction string, reference string")
    good, seen = prep.observed_contract(rows([("a", "b"), ("c", "d")]))
    good.write.format("noop").mode("overwrite").save()
    assert prep.check_contract(seen) == {"n_pred": 2, "n_ref": 2}
    for data in ([("a", None), ("c", "d")], [("a", None)][:0]):
        bad, seen = prep.observed_contract(rows(data))
        bad.write.format("noop").mode("overwrite").save()
        with pytest.raises(ValueError, match="predictions for"):
            prep.check_contract(seen)


def test_leakage_audit_finds_titles_of_a_row_split(spark):
    rows = [("t1", "train"), ("t1", "test"), ("t2", "train"), ("t2", "train"), ("t3", "val"), (None, "val"), (None, "test")] + [("hot", "test")] * 50
    df = spark.createDataFrame(rows, "question_title string, split string")
    got = {r["split"]: (r["rows"], r["titles"], r["leaking_titles"]) for r in split.split_audit(df).collect()}
    assert got == {"train": (3, 2, 1), "test": (52, 2, 1), "val": (2, 1, 0)}


def log(spark, rows):
    return spark.createDataFrame(rows, "setting double, step long, phase string, loss double")


def test_sweep_compares_at_the_last_common_step(spark):
    rows = [(s, k, "train", 10.0 - k - s) for s in (1.0, 2.0) for k in range(6)] + [(s, k, "eval", 8.0 - k + s) for s in (1.0, 2.0) for k in (1, 3)] + [(1.0, 5, "eval", 1.0)]
    got = {r["setting"]: r.asDict() for r in sweep.sweep_table(log(spark, rows)).collect()}
    assert got[1.0] == {"setting": 1.0, "common_step": 3, "train_loss": pytest.approx(7.5), "eval_loss": 6.0, "best_eval_loss": 1.0, "best_eval_step": 5}
    assert got[2.0] == {"setting": 2.0, "common_step": 3, "train_loss": pytest.approx(6.5), "eval_loss": 7.0, "best_eval_loss": 7.0, "best_eval_step": 3}
    wide = {r["step"]: r for r in sweep.wide_curves(log(spark, rows), [(1.0, "one"), (2.0, "two")]).collect()}
    assert wide[5]["eval_one"] == 1.0 and wide[5]["eval_two"] is None and wide[0]["train_two"] == 8.0 and len(wide) == 6


def test_sweep_without_a_common_step(spark):
    got = {r["setting"]: r for r in sweep.sweep_table(log(spark, [(1.0, 1, "eval", 2.0), (2.0, 2, "eval", 3.0), (3.0, 1, "train", 1.0)])).collect()}
    assert all(r["common_step"] is None and r["eval_loss"] is None for r in got.values())
    assert got[3.0]["best_eval_loss"] is None and got[1.0]["best_eval_step"] == 1
    assert sweep.sweep_table(log(spark, [])).count() == 0


def test_mixed_idx_is_refused(spark):
    d = tempfile.mkdtemp(prefix="mixed-")
    with open(f"{d}/p.jsonl", "w") as f:
        f.write("\n".join(json.dumps(x) for x in ({"text": "a"}, {"idx": 5, "text": "b"}, {"text": "c"})))
    with pytest.raises(ValueError, match="1 of 3"):
        files.read_predictions(spark, d, "jsonl")
    with pytest.raises(ValueError, match="1 of 3"):
        files.read_samples(spark, d, num_samples=2)

"""Lists in one JSON document by splits against the one-task reader."""

import glob
import json
import os
import random
import tempfile

import pytest

from corpuskit.sources import files


def texts(n=300, seed=1):
    rng = random.Random(seed)
    parts = ['say "hi" ', "back\\slash", "\\\\", '\\"', "[", "]", "{", "}", ":", ",", "é€😀", "\n\t", "plain words ", "x" * 200, ""]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 12]))) for _ in range(n)]


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(document, **how):
    path = tempfile.mkdtemp(prefix="jsons-") + "/doc.json"
    with open(path, "w") as f:
        json.dump(document, f, **how)
    return path


def same(spark, path, shape, want):
    got = sorted((r["idx"], r["text"]) for r in files.read_predictions_splits(spark, path, shape).collect())
    assert got == list(enumerate(want))


@pytest.mark.parametrize("how", [{}, {"ensure_ascii": False}, {"indent": 2}])
def test_array_in_many_tasks(spark, small_splits, how):
    want = texts()
    path = write(want, **how)
    assert sorted((r["idx"], r["text"]) for r in files.read_predictions(spark, path, "array").collect()) == list(enumerate(want))
    same(spark, path, "array", want)


@pytest.mark.parametrize("first", [True, False])
def test_list_under_a_key_among_others(spark, small_splits, first):
    want = texts(150, 2)
    other = {"metrics": {"responses": ["not this"], "a": [1, 2, {"b": "]"}]}, "note": 'responses": [', "references": texts(40, 3)}
    document = {"responses": want} | other if first else other | {"responses": want, "last": "x"}
    same(spark, write(document), "responses", want)


def test_a_string_over_many_splits_and_empty_lists(spark, small_splits):
    long = 'a "quoted" \\ word ' * 1000
    same(spark, write(["x", long, "", long[:3000]]), "array", ["x", long, "", long[:3000]])
    same(spark, write([]), "array", [])
    same(spark, write({"predictions": []}), "predictions", [])
    with pytest.raises(ValueError, match="has no 'responses'"):
        files.read_predictions_splits(spark, write({"predictions": ["a"], "x": {"responses": ["b"]}}), "responses")


@pytest.mark.parametrize("how", [{}, {"indent": 2}])
def test_null_numbers_and_booleans_in_many_tasks(spark, small_splits, how):
    rng = random.Random(4)
    want = [rng.choice([None, None, 7, -1.5, True, "null", "a, \"b\" [", "x" * 300]) for _ in range(400)]
    as_text = [None if x is None else x if isinstance(x, str) else json.dumps(x) for x in want]
    document = {"a": None, "b": [1, None, {"c": None}], "responses": want, "z": [None, "q"]}
    for doc, shape in ((want, "array"), (document, "responses")):
        got = sorted(files.read_predictions_splits(spark, write(doc, **how), shape).collect(), key=lambda r: r["idx"])
        assert [tuple(r) for r in got] == list(enumerate(as_text)), shape


@pytest.fixture()
def small_parts(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def evaluated(spark, rows, order="idx"):
    path = tempfile.mkdtemp(prefix="eval-") + "/doc"
    responses = spark.createDataFrame(rows, "idx long, text string").repartition(3)
    metrics = spark.createDataFrame([(len(rows), 'say "hi" [', None)], "answers long, note string, none string")
    files.write_evaluation(metrics, responses, path, order)
    parts = [p for p in sorted(glob.glob(f"{path}/part-*")) if os.path.getsize(p)]
    return path, parts, "".join(open(p, encoding="utf-8").read() for p in parts)


def in_order(rows):
    return [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]


def test_evaluation_is_one_document_in_parts(spark, small_parts):
    """No task writes or reads the whole document: nulls, copies and strings
    longer than a split included."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(150)]), t) for t in texts(400, 6) + [None] * 60 + ["same"] * 5 + ['a "long" \\ one ' * 300]]
    path, parts, whole = evaluated(spark, rows)
    want = in_order(rows)
    assert len(parts) > 3 and max(map(os.path.getsize, parts)) < len(whole) / 2
    assert json.loads(whole) == {"metrics": {"answers": len(rows), "note": 'say "hi" ['}, "responses": want}
    got = files.read_predictions(spark, path, "responses", parts=True)
    assert got.rdd.getNumPartitions() > 3
    assert [tuple(r) for r in sorted(got.collect(), key=lambda r: r["idx"])] == list(enumerate(want))
    assert files.read_evaluation_metrics(spark, path, "answers long, note string, none string").collect() == [(len(rows), 'say "hi" [', None)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, "a")], [(3, ']}'), (2, '{"metrics":'), (2, None)]])
def test_small_evaluations_are_one_file(spark, rows):
    path, parts, whole = evaluated(spark, rows)
    assert len(parts) == 1
    assert json.loads(whole)["responses"] == in_order(rows)
    got = files.read_predictions(spark, path, "responses", parts=True).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["idx"])] == list(enumerate(in_order(rows)))
    assert files.read_evaluation_metrics(spark, path, "answers long").collect() == [(len(rows),)]


def test_array_in_parts(spark, small_parts):
    rows = [(i % 97, t) for i, t in enumerate(texts(300, 8) + [None] * 20)]
    path = tempfile.mkdtemp(prefix="list-") + "/doc"
    files.write_list(spark.createDataFrame(rows, "k long, text string"), path, ["k"], "text", "[", "]")
    got = files.read_predictions(spark, path, "array", parts=True).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["idx"])] == list(enumerate(in_order(rows)))

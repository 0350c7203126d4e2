"""The pipeline against brute force, stage by stage."""

import collections
import re

import llm_cases as C

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    assert list(stages) == ["quality", "line dedup", "near-duplicates", "decontamination", "packing"]

    good = stages["quality"](spark, docs, SF)
    assert good.columns == columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    for i, t in kept.items():
        assert len(C.white_words(t)) >= 50
        assert len(re.findall(r"[#*$%&|<>]", t)) <= 0.12 * len(C.white_words(t))

    lined = stages["line dedup"](spark, good, SF)
    assert lined.columns == columns
    source = sorted(kept.items())
    want = {}
    for (i, t), gone in zip(source, C.deduped_lines(source)):
        rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or C.white_words(rest):
            want[i] = rest
    got = lined.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    near = stages["near-duplicates"](spark, lined, SF)
    assert near.columns == columns
    source = sorted(want.items())
    ids = {min(source[i][0] for i in g) for g in C.near_groups(source)}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(ids)

    clean = stages["decontamination"](spark, near, SF)
    assert clean.columns == columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i for i in ids if not C.contamination(want[i], items)[3]}
    assert {r["doc_id"] for r in clean.collect()} == left

    packed = stages["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == left
    held = collections.Counter()
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 1024


def test_odd_and_empty_documents(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        assert stage(spark, C.empty(spark), SF).count() == 0
    twins = P.near(spark, docs, SF).groupBy("doc_id", "text").count()
    assert twins.where("count > 1").count() == 0

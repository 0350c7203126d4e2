import pytest
from pyspark.sql import functions as F

from corpuskit.operators import split


@pytest.mark.parametrize("n,expected", [(10, (8, 1, 1)), (50, (40, 7, 3)), (100, (80, 14, 6)),
                                        (200, (160, 28, 12)), (279, (223, 39, 17))])
def test_split_sizes(n, expected):
    assert split.split_sizes(n) == expected


def _titles(spark, n, dup=1):
    rows = [(f"title {i}", f"answer {i}-{j}") for i in range(n) for j in range(dup)]
    return spark.createDataFrame(rows, "question_title string, answer string")


@pytest.mark.parametrize("n,bits", [(10, 16), (279, 16), (279, 4), (1000, 8)])
def test_grouped_split_exact_sizes_no_leakage(spark, n, bits):
    out = split.grouped_split(_titles(spark, n, dup=2), bucket_bits=bits)
    per = {r.split: r.c for r in out.groupBy("split").agg(F.count_distinct("question_title").alias("c")).collect()}
    tr, te, va = split.split_sizes(n)
    assert (per.get("train", 0), per.get("test", 0), per.get("val", 0)) == (tr, te, va)
    assert out.count() == 2 * n
    assert split.split_leakage(out).count() == 0


def test_grouped_split_is_a_hash_rank(spark):
    n = 100
    out = split.grouped_split(_titles(spark, n))
    ranked = sorted(out.select("question_title", "split", split.title_key(F.col("question_title")).alias("k"))
                    .collect(), key=lambda r: r.k)
    assert [r.split for r in ranked] == ["train"] * 80 + ["test"] * 14 + ["val"] * 6


def test_hash_split_is_stable(spark):
    a = split.hash_split(_titles(spark, 300)).collect()
    b = split.hash_split(_titles(spark, 300)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert {r.split for r in a} == {"train", "test", "val"}


def test_hash_split_fractions_and_grouping(spark):
    df = _titles(spark, 20000, dup=1).unionByName(_titles(spark, 100, dup=3))
    out = split.hash_split(df)
    per = {r.split: r.c for r in out.groupBy("split").agg(F.count_distinct("question_title").alias("c")).collect()}
    n = sum(per.values())
    assert abs(per["train"] / n - 0.80) < 0.02 and abs(per["test"] / n - 0.14) < 0.02
    assert split.split_leakage(out).count() == 0


def test_grouped_split_with_hot_title(spark):
    """One title holds a third of all rows: its rows stay together and the
    title counts once in the sizes."""
    rows = [(f"title {i}", f"a{i}") for i in range(400)] + [("hot title", f"h{j}") for j in range(200)]
    df = spark.createDataFrame(rows, "question_title string, answer string")
    out = split.grouped_split(df)
    hot = {r.split for r in out.filter(F.col("question_title") == "hot title").select("split").collect()}
    assert len(hot) == 1 and out.count() == 600
    per = {r.split: r.c for r in out.groupBy("split").agg(F.count_distinct("question_title").alias("c")).collect()}
    assert (per["train"], per["test"], per["val"]) == split.split_sizes(401)


def test_registered_audit_reads_the_split_by_whole_title(spark, monkeypatch):
    from corpuskit.plans import queries_prep
    from corpuskit.plans.registry import all_queries

    rows = [("abc one", "x", "train"), ("abc one", "y", "test"), ("abc two", "x", "train"), ("abc three", "x", "test")]
    monkeypatch.setattr(queries_prep, "split_df", lambda spark, sf: spark.createDataFrame(rows, "question_title string, answer string, split string"))
    got = all_queries()["split_title_leakage"](spark, "").collect()
    assert [(r["question_title"], r["n_splits"]) for r in got] == [("abc one", 2)]

import math

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.functions.stemming import stems
from corpuskit.functions.text import bleu_tokens
from corpuskit.operators import metrics

SCHEMA = "pair_id long, reference string, hypothesis string"


def _scores(spark, pairs, stemmer=None):
    df = spark.createDataFrame(pairs, SCHEMA)
    return {r.pair_id: r for r in metrics.per_sample_scores(df, stemmer).collect()}


def test_golden_cat_sentences(spark):
    s = _scores(spark, [(1, "the cat sat on the mat", "the cat on the mat")])[1]
    assert s.rouge1_f1 == pytest.approx(10 / 11)
    assert s.rouge2_f1 == pytest.approx(2 / 3)
    assert s.rougeL_f1 == pytest.approx(10 / 11)
    assert s.bleu == pytest.approx(0.308345, abs=1e-6)


def test_bleu_closed_form(spark):
    p = [1, 3 / 4, 1 / 3, (math.log(5) / 10) / 2]
    expected = math.exp(1 - 6 / 5) * math.exp(sum(math.log(x) for x in p) / 4)
    s = _scores(spark, [(1, "The cat sat on the mat", "the CAT on the mat")])[1]
    assert s.bleu == pytest.approx(expected)


def test_empty_sides_score_zero(spark):
    s = _scores(spark, [(1, "", "a b"), (2, "a b", ""), (3, None, None), (4, "x y", "p q")])
    for k in (1, 2, 3, 4):
        assert (s[k].rouge1_f1, s[k].rouge2_f1, s[k].rougeL_f1, s[k].bleu) == (0.0, 0.0, 0.0, 0.0)


def test_identity_scores_one(spark):
    s = _scores(spark, [(1, "a quick brown fox jumps over it", "a quick brown fox jumps over it")])[1]
    assert (s.rouge1_f1, s.rouge2_f1, s.rougeL_f1) == (1.0, 1.0, 1.0)
    assert s.bleu == pytest.approx(1.0)


def test_lcs_cases():
    assert metrics.lcs_length("a b c d b".split(), "b d c b".split()) == 3
    assert metrics.lcs_length([], ["a"]) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=25), st.lists(st.sampled_from("abcde"), max_size=25))
def test_lcs_matches_dynamic_programming(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    assert metrics.lcs_length(a, b) == m[-1][-1]


def test_scores_bounded_on_corpus(spark):
    from conftest import SF_SMALL
    from corpuskit.sources import derived

    s = metrics.per_sample_scores(derived.score_pairs(spark, SF_SMALL))
    for r in s.collect():
        for v in (r.rouge1_f1, r.rouge2_f1, r.rougeL_f1, r.bleu):
            assert 0.0 <= v <= 1.0 + 1e-12


def test_accented_letters_are_separators(spark):
    s = _scores(spark, [(1, "café olé", "caf ol")])[1]
    assert s.rouge1_f1 == 1.0


@pytest.mark.parametrize("word,expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("hopping", "hop"),
    ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalizations", "gener"),
    ("running", "run"), ("dying", "die"), ("enjoy", "enjoy"), ("spied", "spi")])
def test_stems(spark, word, expected):
    assert stems(spark.createDataFrame([(word,)], "token string")).first().stem == expected


def test_stemmed_rouge(spark, monkeypatch):
    df = spark.createDataFrame([(1, "running dogs", "runs dog"), (1, "", "running"), (2, None, None)], SCHEMA)
    assert metrics.rouge_n(df, stem=False).first().rouge1_f1 == 0.0
    for limit in (1 << 20, 0):  # stems looked up in the row, and joined
        monkeypatch.setattr(metrics, "LOOKUP_BYTES", limit)
        got = sorted((r.pair_id, r.rouge1_f1) for r in metrics.rouge_n(df).collect())
        assert got == [(1, 0.0), (1, 1.0), (2, 0.0)]


@pytest.mark.parametrize("text,expected", [
    ("Don't stop, it's 3.5 (or 4)...", ["do", "n't", "stop", ",", "it", "'s", "3.5", "(", "or", "4", ")", "..."]),
    ('She said "Yes." Then left.', ["she", "said", "``", "yes", ".", "''", "then", "left", "."]),
    ("a@b.com: cannot 100% -- #x;", ["a", "@", "b.com", ":", "can", "not", "100", "%", "--", "#", "x", ";"]), (None, []), (" ", [])])
def test_bleu_words(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(bleu_tokens(F.col("t")).alias("w")).first().w == expected


def test_evaluate_responses_counts(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "c d", "e f")], SCHEMA)
    row = metrics.evaluate_responses(df).first()
    assert row.num_samples == 2 and row.num_scored == 2
    refs = spark.range(5)
    assert metrics.evaluate_responses(df, references=refs).first().num_samples == 5
    assert row.rouge1_f1 == pytest.approx(0.5)


def test_token_lists_are_numbered_without_a_python_table_of_the_batch():
    """Rows come one at a time; tokens of one stem get one number."""
    import tracemalloc

    import pyarrow as pa

    lists = lambda rows: pa.array(rows, pa.list_(pa.string()))
    stems = pa.table({"token": ["cats", "dogs"], "stem": ["cat", "dog"]})
    rows = list(metrics._coded(lists([["x"], ["cats", "a"], []]).slice(1), lists([["y"], ["cat", "dogs", "dog"], ["a"]]).slice(1), stems))
    (a, b), (none, c) = rows
    assert a[0] == b[0] and b[1] == b[2] != b[0] and none == [] and c == [a[1]]
    many = lists([[f"w{i}x{j}" for j in range(50)] for i in range(2000)])
    tracemalloc.start()
    assert sum(len(x) + len(y) for x, y in metrics._coded(many, many)) == 200_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # 200,000 strings alone take 11 MB

"""Learned abbreviations and sentence ends in BLEU."""

import math

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import metrics, sentences


def corpus(spark):
    """Abbreviations always with a stop, sentence ends in many words, and a
    word ("ok") that mostly stands without one."""
    words = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(200):
        a, b, c = words[i % 60], words[(7 * i) % 60], words[(11 * i) % 60]
        texts.append(f"Then Dr. {a} met {b} (e.g. the {c}). Ok {b} and {a}. {i % 9} ok {c} at 5 p.m. in the hall by {a}.")
    return spark.createDataFrame([(t,) for t in [*texts, None, "", "... .. ."]], "text string")


def test_abbreviations_are_told_from_sentence_ends(spark):
    got = {r["abbreviation"]: r for r in sentences.abbreviations(corpus(spark), "text").collect()}
    assert {"dr", "e.g", "p.m"} <= set(got) and not {"ok", "hall", "the", "word1"} & set(got)
    dr = got["dr"]
    counts = sentences.type_counts(corpus(spark), "text").agg(F.sum("with_stop").alias("p"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("n")).first()
    share = counts["p"] / counts["n"]
    assert (dr["with_stop"], dr["without_stop"]) == (200, 0)
    assert dr["score"] == pytest.approx(2 * 200 * (math.log(0.99) - math.log(share)) * math.exp(-2))


def test_no_words_or_only_stops_learn_nothing(spark):
    for texts in ([], [None, ""], ["a. b.", "c."]):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert sentences.abbreviations(df, "text").count() == 0


CASES = [("Dr. Who met e.g. Tom. He ran.", ["dr.", "who", "met", "e.g.", "tom", ".", "he", "ran", "."]),
         ("see Dr.", ["see", "dr", "."]),  # the last word's stop ends the text
         ("(p.m.) is late. \"Dr. No\"", ["(", "p.m", ".", ")", "is", "late", ".", "``", "dr.", "no", "''"]),
         ("a.b. c", ["a.b", ".", "c"]), ("wait... Dr.\n\nJo", ["wait", "...", "dr.", "jo"]), (None, []), ("", [])]


@pytest.mark.parametrize("limit", [1 << 16, 0])  # names in the plan, names joined
def test_tokens_keep_the_stops_of_abbreviations(spark, monkeypatch, limit):
    monkeypatch.setattr(sentences, "NAMES_BYTES", limit)
    names = spark.createDataFrame([("dr",), ("e.g",), ("unused",)], "abbreviation string")
    df = spark.createDataFrame([(i, t, "dr. x") for i, (t, _) in enumerate(CASES)], "i long, t string, u string")
    got = sentences.sentence_tokens(df, {"a": "t", "b": "u"}, names).orderBy("i").collect()
    assert [r["a"] for r in got] == [w for _, w in CASES]
    assert all(r["b"] == ["dr.", "x"] for r in got)


def test_bleu_counts_abbreviations_as_words(spark):
    pairs = spark.createDataFrame([(1, "Dr. Who ran home now.", "Dr. Who ran home now."), (2, "ask dr. who today", "ask dr who today ."), (3, None, "x")], "pair_id long, reference string, hypothesis string")
    names = spark.createDataFrame([("dr",)], "abbreviation string")
    learned = {r["pair_id"]: r["bleu"] for r in metrics.bleu(pairs, names).collect()}
    plain = {r["pair_id"]: r["bleu"] for r in metrics.bleu(pairs).collect()}
    assert learned[1] == pytest.approx(1.0) and learned[3] == 0.0
    assert learned[2] < plain[2]  # "dr." is one word that the hypothesis lacks
    none = metrics.bleu(pairs, names.limit(0)).collect()
    assert {r["pair_id"]: r["bleu"] for r in none} == pytest.approx(plain)

"""Rows-only metric queries checked against a brute-force Python scorer on
the sf0.001 scoring pairs (written here from the published formulas)."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from porter_bruteforce import stem
from corpuskit.functions.text import bleu_tokens
from corpuskit.operators import metrics
from corpuskit.sources import derived

def rouge_tokens(text, use_stem=False):
    toks = [t for t in re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split() if t]
    return [stem(t) if use_stem and len(t) > 3 else t for t in toks]


def ngram_counts(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def f1(overlap, nr, nh):
    p, r = overlap / max(nh, 1), overlap / max(nr, 1)
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_n(ref, hyp, n):
    cr, ch = ngram_counts(ref, n), ngram_counts(hyp, n)
    return f1(sum((cr & ch).values()), sum(cr.values()), sum(ch.values()))


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def rouge_l(ref, hyp):
    if not ref or not hyp:
        return 0.0
    return f1(lcs(ref, hyp), len(ref), len(hyp))


def bleu(ref, hyp):
    if not ref or not hyp:
        return 0.0
    nums, dens = [], []
    for n in range(1, 5):
        ch, cr = ngram_counts(hyp, n), ngram_counts(ref, n)
        nums.append(sum(min(c, cr[g]) for g, c in ch.items()))
        dens.append(max(1, sum(ch.values())))
    if nums[0] == 0:
        return 0.0
    h, r = len(hyp), len(ref)
    p, k = [], 1
    for num, den in zip(nums, dens):
        if num == 0 and h > 1:
            p.append((1 / (2 ** k * 5 / math.log(h))) / den)
            k += 1
        else:
            p.append(num / den)
    bp = 1.0 if h > r else math.exp(1 - r / h)
    return bp * math.exp(math.fsum(0.25 * math.log(x) for x in p if x > 0))


@pytest.mark.parametrize("use_stem", [False, True])
def test_per_sample_scores_match_brute_force(spark, use_stem):
    pairs = derived.score_pairs(spark, SF_SMALL)
    got = {r.pair_id: r for r in metrics.per_sample_scores(
        pairs, stem=use_stem).collect()}
    rows = pairs.select("*", bleu_tokens(F.col("reference")).alias("wr"), bleu_tokens(F.col("hypothesis")).alias("wh")).collect()
    assert len(got) == len(rows) > 0
    for row in rows:
        ref, hyp = rouge_tokens(row.reference, use_stem), rouge_tokens(row.hypothesis, use_stem)
        g = got[row.pair_id]
        assert g.rouge1_f1 == pytest.approx(rouge_n(ref, hyp, 1), abs=1e-12)
        assert g.rouge2_f1 == pytest.approx(rouge_n(ref, hyp, 2), abs=1e-12)
        assert g.rougeL_f1 == pytest.approx(rouge_l(ref, hyp), abs=1e-12)
        assert g.bleu == pytest.approx(bleu(row.wr, row.wh), abs=1e-9)


def test_evaluate_responses_is_the_mean(spark):
    pairs = derived.score_pairs(spark, SF_SMALL)
    per = metrics.per_sample_scores(pairs).collect()
    agg = metrics.evaluate_responses(pairs).first()
    assert agg.num_samples == len(per)
    assert agg.rougeL_f1 == pytest.approx(sum(r.rougeL_f1 for r in per) / len(per))
    assert agg.bleu_score == pytest.approx(sum(r.bleu for r in per) / len(per))

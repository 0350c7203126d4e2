"""Text-overlap metrics as corpus-scale Spark jobs.

Input is a pairs table ``(pair_id, reference, hypothesis)``; a pair is one row
and is scored in that row.  ROUGE tokens are stemmed (as the usual scorer with
its stemmer on does): the corpus's distinct tokens are stemmed once, as
Catalyst expressions, and rows look their stems up.  All n-gram overlaps and
the longest common subsequence then come from one Arrow-batched pass, and the
scores from them are Catalyst expressions.  Nothing is joined or regrouped by
``pair_id``, so ids may repeat.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import stems
from ..functions.text import bleu_tokens, rouge_tokens
from ..session import materialize
from .sentences import sentence_tokens

ROUGE_ORDERS, BLEU_ORDERS = (1, 2), (1, 2, 3, 4)
LOOKUP_BYTES = 32 << 20  # of tokens and stems that every task may hold as a table; beyond it rows and stems are joined

SCORES = ("rouge", "lcs", "bleu")
FIELDS = {"rouge": [f"rouge_o{n}" for n in ROUGE_ORDERS], "lcs": ["lcs"], "bleu": [f"bleu_o{n}" for n in BLEU_ORDERS]}


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence length, bit-parallel (one big-int row of
    the DP table per token of ``b``)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def overlap(a: list, b: list, n: int) -> int:
    """Clipped n-gram matches of two token lists."""
    left = Counter(zip(*(a[i:] for i in range(n))))
    right = Counter(zip(*(b[i:] for i in range(n))))
    return sum(min(c, right[g]) for g, c in left.items() if g in right)


def _coded(left: pa.Array, right: pa.Array, stems: pa.Table | None = None) -> Iterator[tuple[list[int], list[int]]]:
    """Rows of two columns of token lists as numbers, equal for equal tokens
    (or stems).  Only one row at a time becomes Python objects."""
    flat = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    words, codes = flat.dictionary, flat.indices
    if stems is not None:
        known, stem = (stems[c].combine_chunks().cast(words.type) for c in ("token", "stem"))
        words = pc.coalesce(stem.take(pc.index_in(words, known)), words)
        codes = words.dictionary_encode().indices.take(codes)
    codes = codes.to_numpy()
    ends = np.cumsum(np.concatenate([[0], *(pc.list_value_length(x).to_numpy() for x in (left, right))]))
    n = len(left)
    for i in range(n):
        yield codes[ends[i]:ends[i + 1]].tolist(), codes[ends[n + i]:ends[n + i + 1]].tolist()


def _struct(columns: dict[str, list[int]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))


def _counter(shared, scores: tuple[str, ...]):
    """The pass over a batch of pairs for the scores that are asked for, with a
    broadcast table of tokens and stems.  Of the four token lists, those that
    no score needs come as nulls."""
    fields = T.StructType([T.StructField(f, T.LongType()) for s in SCORES if s in scores for f in FIELDS[s]])

    @F.arrow_udf(fields)
    def count(rt: pa.Array, ht: pa.Array, wr: pa.Array, wh: pa.Array) -> pa.Array:
        out: dict[str, list[int]] = {f: [] for s in SCORES if s in scores for f in FIELDS[s]}
        if "rouge" in scores or "lcs" in scores:
            for r, h in _coded(rt, ht, shared.value if shared is not None else None):
                if "rouge" in scores:
                    for f, n in zip(FIELDS["rouge"], ROUGE_ORDERS):
                        out[f].append(overlap(r, h, n))
                if "lcs" in scores:
                    out["lcs"].append(lcs_length(r, h))
        if "bleu" in scores:
            for a, b in _coded(wr, wh):
                for f, n in zip(FIELDS["bleu"], BLEU_ORDERS):
                    out[f].append(overlap(a, b, n))
        return _struct(out)

    return count


BLEU_COUNTS = T.StructType([T.StructField(f"bleu_o{n}", T.LongType()) for n in BLEU_ORDERS])


@F.arrow_udf(BLEU_COUNTS)
def _bleu_matches(wr: pa.Array, wh: pa.Array) -> pa.Array:
    rows = [[overlap(a, b, n) for n in BLEU_ORDERS] for a, b in _coded(wr, wh)]
    return _struct({f: [row[k] for row in rows] for k, f in enumerate(BLEU_COUNTS.fieldNames())})


def _distinct_stems(tok: DataFrame) -> DataFrame:
    """(token, stem) of the distinct ROUGE tokens whose stem differs."""
    tokens = tok.select(F.explode(F.array_distinct(F.concat("__rt", "__ht"))).alias("token")).distinct()
    # written before it is filtered: a filter pushed below the stemming steps would nest them
    return materialize(stems(tokens), "stems").filter("stem != token")


def _join_stems(tok: DataFrame, table: DataFrame) -> DataFrame:
    """Stemmed token arrays by a join: the way beyond ``LOOKUP_TOKENS``."""
    keyed = materialize(tok.withColumn("__row", F.monotonically_increasing_id()), "tokens")
    sides = []
    for c in ("__rt", "__ht"):
        flat = keyed.select("__row", F.posexplode(c).alias("i", "token")).join(table, "token", "left")
        flat = flat.select("__row", F.struct("i", F.coalesce("stem", "token").alias("t")).alias("x"))
        sides.append(flat.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias(f"{c}s")))
    joined = keyed.join(sides[0], "__row", "left").join(sides[1], "__row", "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("__rt", F.coalesce("__rts", none)).withColumn("__ht", F.coalesce("__hts", none)).drop("__row", "__rts", "__hts")


def pair_counts(pairs: DataFrame, stem: bool = True, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Every pair with the match counts of the asked ``scores`` (``FIELDS``)
    and token numbers ``rn``, ``hn`` (ROUGE) and ``rw``, ``hw`` (BLEU); texts
    are only cut into the tokens that those need."""
    rouge, none = "rouge" in scores or "lcs" in scores, F.lit(None).cast("array<string>")
    cut = lambda f, c, needed: f(F.col(c)) if needed else none
    tok = pairs.select("*", cut(rouge_tokens, "reference", rouge).alias("__rt"), cut(rouge_tokens, "hypothesis", rouge).alias("__ht"),
                       cut(bleu_tokens, "reference", "bleu" in scores).alias("__wr"), cut(bleu_tokens, "hypothesis", "bleu" in scores).alias("__wh"))
    shared = None
    if stem and rouge:
        table = _distinct_stems(tok)
        size = table.agg(F.coalesce(F.sum(F.octet_length("token") + F.octet_length("stem")), F.lit(0)).alias("n")).first()["n"]
        if size <= LOOKUP_BYTES:
            shared = pairs.sparkSession.sparkContext.broadcast(table.toArrow())
        else:
            tok = _join_stems(tok, table)
    counted = tok.withColumn("__c", _counter(shared, scores)("__rt", "__ht", "__wr", "__wh"))
    sizes = [F.size(c).alias(n) for c, n in (("__rt", "rn"), ("__ht", "hn"), ("__wr", "rw"), ("__wh", "hw"))]
    return counted.select(*pairs.columns, *sizes, "__c.*")


def _f1(matches: Column, n_ref: Column, n_hyp: Column) -> Column:
    p = matches / F.greatest(n_hyp, F.lit(1))
    r = matches / F.greatest(n_ref, F.lit(1))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _rouge_cols(orders) -> list[Column]:
    more = lambda c, n: F.greatest(F.col(c) - (n - 1), F.lit(0))
    return [_f1(F.col(f"rouge_o{n}"), more("rn", n), more("hn", n)).alias(f"rouge{n}_f1") for n in orders]


def _rouge_l_col() -> Column:
    return _f1(F.col("lcs"), F.col("rn"), F.col("hn")).alias("rougeL_f1")


def _bleu_col(k: float = 5.0) -> Column:
    """Sentence BLEU-4 with smoothing method 4.

    p_n = clipped matches / max(1, hyp n-grams).  No unigram match, or an
    empty side, scores 0.  With h > 1 hypothesis tokens, the j-th order with
    no match (j = 1, 2, ...) gets ``ln(h) / (k * 2**j)`` as numerator.
    Orders with p_n = 0 are skipped in the geometric mean; BP = 1 if h > r
    else exp(1 - r/h).
    """
    h, r = F.col("hw"), F.col("rw")
    log_terms = []
    zeros_before = F.lit(0)
    for n in BLEU_ORDERS:
        m = F.col(f"bleu_o{n}")
        denom = F.greatest(h - (n - 1), F.lit(1)).cast("double")
        smoothed = F.log(h.cast("double")) / (F.lit(k) * F.pow(F.lit(2.0), zeros_before + 1)) / denom
        p = F.when(m > 0, m / denom).when(h > 1, smoothed).otherwise(F.lit(0.0))
        log_terms.append(F.when(p > 0, F.log(p) / len(BLEU_ORDERS)).otherwise(F.lit(0.0)))
        zeros_before = zeros_before + F.when(m == 0, 1).otherwise(0)
    bp = F.when(h > r, F.lit(1.0)).otherwise(F.exp(1 - r / F.greatest(h, F.lit(1))))
    score = bp * F.exp(functools.reduce(lambda a, b: a + b, log_terms))
    return F.when((r == 0) | (h == 0) | (F.col("bleu_o1") == 0), F.lit(0.0)).otherwise(score).alias("bleu")


def rouge_n(pairs: DataFrame, orders: tuple[int, ...] = ROUGE_ORDERS, stem: bool = True) -> DataFrame:
    """ROUGE-1 / ROUGE-2 F1 per pair: ``pair_id, rouge{n}_f1``."""
    return pair_counts(pairs, stem, ("rouge",)).select("pair_id", *_rouge_cols(orders))


def rouge_l(pairs: DataFrame, stem: bool = True) -> DataFrame:
    """ROUGE-L F1 per pair: ``pair_id, rougeL_f1`` (0 if either side is empty)."""
    return pair_counts(pairs, stem, ("lcs",)).select("pair_id", _rouge_l_col())


def bleu(pairs: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """Sentence BLEU per pair: ``pair_id, bleu``.  With learned
    ``abbreviations`` full stops are words of their own only at sentence ends."""
    if abbreviations is None:
        return pair_counts(pairs, False, ("bleu",)).select("pair_id", _bleu_col())
    tok = sentence_tokens(pairs.select("pair_id", "reference", "hypothesis"), {"__wr": "reference", "__wh": "hypothesis"}, abbreviations)
    counted = tok.select("pair_id", F.size("__wr").alias("rw"), F.size("__wh").alias("hw"), _bleu_matches("__wr", "__wh").alias("__c"))
    return counted.select("pair_id", "rw", "hw", "__c.*").select("pair_id", _bleu_col())


def per_sample_scores(pairs: DataFrame, stem: bool = True) -> DataFrame:
    """ROUGE-1/2/L F1 and BLEU per pair, with the pair's other columns except
    its two texts."""
    rest = [c for c in pairs.columns if c not in ("reference", "hypothesis")]
    return pair_counts(pairs, stem).select(*rest, *_rouge_cols(ROUGE_ORDERS), _rouge_l_col(), _bleu_col())


def evaluate_responses(pairs: DataFrame, stem: bool = True, references: DataFrame | None = None) -> DataFrame:
    """Corpus means of the four scores over the scored pairs (one row).

    ``num_samples`` counts the references (all of ``references`` when given,
    so references without a hypothesis still count), ``num_scored`` the pairs
    actually scored."""
    s = per_sample_scores(pairs, stem)
    means = s.agg(F.avg("rouge1_f1").alias("rouge1_f1"), F.avg("rouge2_f1").alias("rouge2_f1"),
                  F.avg("rougeL_f1").alias("rougeL_f1"), F.avg("bleu").alias("bleu_score"),
                  F.count(F.lit(1)).alias("num_scored"))
    if references is None:
        return means.withColumn("num_samples", F.col("num_scored"))
    n_ref = references.agg(F.count(F.lit(1)).alias("num_samples"))
    return means.crossJoin(n_ref)  # two one-row aggregates

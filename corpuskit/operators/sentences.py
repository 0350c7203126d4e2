"""Sentence ends, by abbreviations learned from the corpus.

A full stop at the end of a word ends a sentence unless the word is an
abbreviation.  Abbreviations are told as in the published unsupervised method
(Kiss and Strunk, 2006): a word type that nearly always stands with a full stop
has a high likelihood ratio against the corpus's share of words with one; the
ratio is weighted down for long types and for every time that the type stands
without, and up for inner full stops.

Learning is one grouped count of types (combined before the shuffle) and a
score per type.  Looking up is narrow while the learned names are few
(``NAMES_BYTES`` of text); beyond it the words that end with a stop are joined
with the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLEU_SPACE, bleu_tokens
from ..session import materialize

# Fixed values of the published method.
WITH_STOP, LEAST_SCORE = 0.99, 0.3

NAMES_BYTES = 1 << 16  # of abbreviations that a plan may hold as constants
_KEPT = "\ue000"  # stands for a full stop that ends no sentence


def words(text: Column) -> Column:
    """Lower-cased white-space words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLEU_SPACE), lambda w: w != "")


def bare(word: Column) -> Column:
    """The word without marks around it, full stops aside."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$", "")


def ends_with_stop(bare_word: Column) -> Column:
    return bare_word.rlike(r"[^.]\.$")


def type_of(bare_word: Column) -> Column:
    return F.when(ends_with_stop(bare_word), F.regexp_replace(bare_word, r"\.$", "")).otherwise(bare_word)


def type_counts(df: DataFrame, text: str) -> DataFrame:
    """(type, with_stop, without_stop) of all words."""
    word = df.select(F.explode(F.transform(words(F.col(text)), bare)).alias("w")).where("w != ''")
    return word.groupBy(type_of(F.col("w")).alias("type")).agg(F.count_if(ends_with_stop(F.col("w"))).alias("with_stop"), F.count_if(~ends_with_stop(F.col("w"))).alias("without_stop"))


def abbreviations(df: DataFrame, text: str) -> DataFrame:
    """(abbreviation, with_stop, without_stop, score) learned from ``text``; no
    rows if no word, or every word, ends with a full stop."""
    counts = materialize(type_counts(df, text), "word-types")
    total = counts.agg(F.sum("with_stop").alias("__p"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("__n"))
    scored = counts.where("with_stop > 0").where(F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(total)).where("__p < __n")  # one row
    share = F.col("__p") / F.col("__n")
    log_ratio = 2 * (F.col("with_stop") * (F.log(F.lit(WITH_STOP)) - F.log(share)) + F.col("without_stop") * (F.log(F.lit(1 - WITH_STOP)) - F.log(1 - share)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = log_ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("without_stop").cast("double"))
    return scored.withColumn("score", score).where(F.col("score") >= LEAST_SCORE).select(F.col("type").alias("abbreviation"), "with_stop", "without_stop", "score")


def _kept(word: Column, known: Column, last: Column) -> Column:
    """The word with its final full stop kept on, if it ends no sentence."""
    return F.when(known & ~last, F.regexp_replace(word, r"\.([^\p{L}\p{N}.]*)$", _KEPT + "$1")).otherwise(word)


def _tokens(marked: Column) -> Column:
    return F.transform(bleu_tokens(F.array_join(marked, " ")), lambda t: F.translate(t, _KEPT, "."))


def sentence_tokens(df: DataFrame, columns: dict[str, str], names: DataFrame) -> DataFrame:
    """``df`` with BLEU tokens of every text column (out: text column), full
    stops split off only where a sentence ends."""
    names = materialize(names.select("abbreviation"), "abbreviations")
    size = names.agg(F.coalesce(F.sum(F.octet_length("abbreviation")), F.lit(0)).alias("n")).first()["n"]

    def marked(text: str, known) -> Column:
        # the text's words are bound once, as the only element of an outer array
        return F.element_at(F.transform(F.array(words(F.col(text))), lambda ws: F.transform(ws, lambda w, i: _kept(w, known(w), i == F.size(ws) - 1))), 1)

    def stopped(w: Column) -> Column:
        return ends_with_stop(bare(w))

    if size <= NAMES_BYTES:
        held = [r["abbreviation"] for r in names.collect()]
        known = lambda w: stopped(w) & type_of(bare(w)).isin(held) if held else F.lit(False)
        return df.select("*", *[_tokens(marked(text, known)).alias(out) for out, text in columns.items()])
    keyed = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "texts")
    ends = F.flatten(F.array(*[F.transform(F.filter(words(F.col(t)), stopped), lambda w: type_of(bare(w))) for t in columns.values()]))
    met = keyed.select("__row", F.explode(F.array_distinct(ends)).alias("abbreviation")).join(names, "abbreviation")
    met = met.groupBy("__row").agg(F.collect_set("abbreviation").alias("__met"))
    joined = keyed.join(met, "__row", "left").withColumn("__met", F.coalesce("__met", F.array().cast("array<string>")))
    known = lambda w: stopped(w) & F.array_contains(F.col("__met"), type_of(bare(w)))
    return joined.select(*df.columns, *[_tokens(marked(text, known)).alias(out) for out, text in columns.items()])

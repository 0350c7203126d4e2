"""Quality rules with adaptive limits (DataFrame expressions only).

Fixed cutoffs are replaced by limits from quantile sketches per language and
source, over the documents that the base rules pass.  A sketch is a table of
(bucket, count): a whole-number metric under 1024 is its own bucket, a larger
one keeps its ten leading bits (an error under 0.2 %), so a sketch has a bounded
number of rows, and sketches merge by adding counts (a language's is the sum of
its groups', and so on).

A document fails if a metric is over ``q50 + max(floor, spread * (upper - q50))``
of its group, where ``upper`` is the metric's upper quantile (``METRICS``); the
mean word length also under the mirrored limit.  Every quantile of a group is
drawn towards its language's, and that one towards the whole corpus's, as if
``PRIOR`` documents of that kind were added: one rule at every size, by which
limits move smoothly as a group grows.  The floor only decides where a metric's
spread is (nearly) zero.

Null or empty text: no words, so the base rule rejects it.  Very long texts are
measured whole, in the row.  Null language or source: a group like any other.
Repeated rows count each.  An empty table gives an empty result.  Any extra
columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import named
from corpuskit.session import materialize

# metric: upper quantile in eighths, spread, floor (smallest distance of the limit from the median, in the metric's unit)
METRICS = {"symbol_pm": (6, 12, 100), "dup_line_pm": (7, 12, 400), "repeat_pm": (7, 32, 250), "word_len_pc": (6, 12, 50)}
PRIOR = 30  # documents that the wider sketch counts for

_LONG = "bigint"


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space ones."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _repeat_words(words: Column, triples: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more."""
    ordered = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, j: Column, arr: Column) -> Column:
        return (F.coalesce(F.get(arr, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(arr, j + 1)["h"] == x["h"], F.lit(False)))

    # the sorted array is bound once, as the only element of an outer array
    places = F.element_at(F.transform(F.array(ordered), lambda arr: F.sort_array(F.transform(F.filter(arr, lambda x, j: twice(x, j, arr)), lambda x: x["i"]))), 1)
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast(_LONG).alias("n"))
    count = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(triples)) == F.size(triples), F.lit(0).cast(_LONG)).otherwise(count)


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``doc`` (a struct of the carried columns), lang, source and the counts
    of every whole text: n_words, word_chars, n_symbols, n_lines (with a
    word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.select(F.struct(*named(carry)).alias("doc"), "lang", "source", words_of(F.col("text")).alias("_w"), lines.alias("_l"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast(_LONG).alias("n_symbols"))
    step = step.select("doc", "lang", "source", "n_symbols", "_w", F.size("_w").cast(_LONG).alias("n_words"), F.length(F.concat_ws("", "_w")).cast(_LONG).alias("word_chars"),
                       F.size("_l").cast(_LONG).alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast(_LONG).alias("n_dup_lines"))
    at = F.sequence(F.lit(0), F.size("_w") - 3)
    triples = F.when(F.size("_w") >= 3, F.transform(at, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("_t", triples)
    return step.withColumn("n_repeat_words", _repeat_words(F.col("_w"), F.col("_t"))).drop("_w", "_t")


def _metrics() -> dict[str, Column]:
    per = lambda a, unit, b: F.expr(f"({unit} * {a}) div nullif({b}, 0)")
    return {"symbol_pm": per("n_symbols", 1000, "n_words"), "dup_line_pm": per("n_dup_lines", 1000, "n_lines"),
            "repeat_pm": per("n_repeat_words", 1000, "n_words"), "word_len_pc": per("word_chars", 100, "n_words")}


def bucket(value: Column) -> Column:
    """The value with all but its ten leading bits cleared."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 10)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch per group and metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(c).alias("bucket")) for m, c in _metrics().items()]))
    return measured.where(~base_failed()).select("lang", "source", pairs.alias("p")).groupBy("lang", "source", F.col("p.metric").alias("metric"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _of_metric(which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x).cast(_LONG) if i else F.lit(x) for m, told in METRICS.items() for i, x in enumerate((m, told[which]))]), F.col("metric"))


def _quantiles(sketch: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """docs, lower quantile, median and upper quantile of each sketch (a quantile
    is the first bucket at which the running count reaches its share)."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "metric")))
    reach = lambda k: F.min(F.when(F.col("upto") * 8 >= F.col("total") * k, F.col("bucket")))
    eighth = _of_metric(0)
    return run.groupBy(*keys, "metric").agg(F.max("total").alias(f"docs{mark}"), reach(8 - eighth).alias(f"lo{mark}"), reach(F.lit(4)).alias(f"mid{mark}"), reach(eighth).alias(f"hi{mark}"))


def limits(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): ``low_<metric>`` and ``high_<metric>``."""
    own = materialize(sketches(measured), "sketches")
    by_lang = _quantiles(own, ["lang"], "1").withColumnsRenamed({"lang": "lang1", "metric": "metric1"})
    all_ = _quantiles(own, [], "2").withColumnRenamed("metric", "metric2")
    joined = _quantiles(own, ["lang", "source"], "0").join(by_lang, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("metric") == F.col("metric1"))).join(all_, F.col("metric") == F.col("metric2"))
    drawn = lambda q: F.expr(f"(docs0 * {q}0 + {PRIOR} * ((docs1 * {q}1 + {PRIOR} * {q}2) div (docs1 + {PRIOR}))) div (docs0 + {PRIOR})")
    told = joined.select("lang", "source", "metric", *[drawn(q).alias(q) for q in ("lo", "mid", "hi")])
    reach = lambda spread: F.greatest(_of_metric(2), _of_metric(1) * spread)
    told = told.select("lang", "source", "metric", (F.col("mid") - reach(F.col("mid") - F.col("lo"))).alias("low"), (F.col("mid") + reach(F.col("hi") - F.col("mid"))).alias("high"))
    return told.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("low", "high")])


def judge(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``doc`` (the carried columns), the counts, base_failed and kept."""
    measured = materialize(measure(docs, carry), "measured")
    told = materialize(limits(measured).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "limits")
    joined = measured.join(told, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    metrics = _metrics()
    within = metrics["word_len_pc"] >= F.col("low_word_len_pc")
    for m, c in metrics.items():
        within = within & (c <= F.col(f"high_{m}"))
    return joined.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept"))

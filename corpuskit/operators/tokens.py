"""Token tables: vocabulary, encoding to fixed-length id arrays, label
masks, token statistics, fixed-size batches and chat rendering.

The vocabulary is learned on Spark (frequency order) in place of a
pretrained subword tokenizer; encoding truncates first, then looks the ids
up in the row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Reserved special tokens, in id order.
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]
PAD, UNK, BOS, EOS = 0, 1, 2, 3

TOKEN_PATTERN = r"<bos>|<eos>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

CHAT_TEMPLATE = "<start_of_turn>{role}\n{text}<end_of_turn>\n"


def tokenize(col: Column) -> Column:
    """Words, single punctuation marks, and the literal ``<bos>``/``<eos>``."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def vocab(df: DataFrame, text: str, vocab_size: int = 32000) -> DataFrame:
    """``(token, id, count)``: specials get ids 0..3, then the
    ``vocab_size`` most frequent tokens (ties by token).  Counting is a
    map-side-combined aggregate; the top-V cut is TakeOrderedAndProject, so
    only V rows ever reach one task."""
    toks = df.select(F.explode(tokenize(F.col(text))).alias("token")).filter(~F.col("token").isin(SPECIALS))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("token")).limit(vocab_size)
    ranked = top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("count").desc(), "token"))
                                   + len(SPECIALS) - 1).cast("int"))
    spark = df.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, count long")
    return specials.unionByName(ranked.select("token", "id", "count"))


# Largest vocabulary that every task holds as a lookup table; beyond it the
# tokens are joined with the vocabulary.
LOOKUP_VOCAB_ROWS = 2_000_000


def _lookup(shared, unknown: int):
    @F.pandas_udf("array<int>")
    def ids(tokens: pd.Series) -> pd.Series:
        known = shared.value
        return tokens.map(lambda ts: [known.get(t, unknown) for t in ts])

    return ids


def _joined_ids(base: DataFrame, v: DataFrame) -> DataFrame:
    """Ids by a join, regrouped by a row number (keys may repeat)."""
    keyed = materialize(base.withColumn("__row", F.monotonically_increasing_id()), "encode-tokens")
    flat = keyed.select("__row", F.posexplode("__t").alias("__pos", "__tok"))
    looked = flat.join(v.select(F.col("token").alias("__tok"), F.col("id").alias("__id")), "__tok", "left")
    entry = F.struct(F.col("__pos"), F.coalesce(F.col("__id"), F.lit(UNK)).alias("id"))
    grouped = looked.groupBy("__row").agg(F.sort_array(F.collect_list(entry)).alias("__e"))
    none = F.array().cast("array<int>")
    return keyed.join(grouped, "__row", "left").withColumn("__ids", F.coalesce(F.col("__e.id"), none)).drop("__row", "__e")


def encode(df: DataFrame, text: str, v: DataFrame, keys: list[str], max_length: int = 128,
           pad_id: int = EOS) -> DataFrame:
    """One row per row of ``df``: ``keys``, ``input_ids``, ``attention_mask``,
    ``labels``, ``n_tokens`` (count before truncation).

    Tokens are truncated to ``max_length`` and looked up in the row (unknown
    -> ``<unk>``): the vocabulary is counted, and up to ``LOOKUP_VOCAB_ROWS``
    rows it goes to every task as a table, so nothing is shuffled and equal
    keys stay apart.  Padding is ``pad_id`` (the end-of-sequence id, as the
    reference's tokenizer is configured); ``labels`` equal the ids where the
    mask is 1 and -100 on padding.
    """
    toks = tokenize(F.col(text))
    base = (df.select(*keys, toks.alias("__all"))
              .select(*keys, F.size("__all").alias("n_tokens"), F.slice("__all", 1, max_length).alias("__t")))
    v = materialize(v.select("token", "id"), "vocab")
    if v.count() <= LOOKUP_VOCAB_ROWS:
        shared = df.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in v.toLocalIterator()})
        looked = base.withColumn("__ids", _lookup(shared, UNK)("__t"))
    else:
        looked = _joined_ids(base, v)
    n = F.size("__ids")
    rest = F.lit(max_length) - n
    return looked.select(
        *keys, "n_tokens",
        F.concat("__ids", F.array_repeat(F.lit(pad_id), rest)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
        F.concat("__ids", F.array_repeat(F.lit(-100), rest)).alias("labels"))


def collator_labels(df: DataFrame, ids: str = "input_ids", pad_id: int = EOS, out: str = "labels") -> DataFrame:
    """Language-modelling collator labels: every pad id -> -100.  With pad =
    EOS a genuine end-of-sequence token is masked as well."""
    return df.withColumn(out, F.transform(F.col(ids), lambda x: F.when(x == pad_id, F.lit(-100)).otherwise(x)))


def token_stats(encoded: DataFrame, group: str, max_length: int = 128) -> DataFrame:
    """Per group: rows, total and mean real tokens, rows that were truncated."""
    real = F.least(F.col("n_tokens"), F.lit(max_length))
    return encoded.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(real).cast("long").alias("total_tokens"),
        F.avg(real).alias("mean_tokens"),
        F.count_if(F.col("n_tokens") > max_length).alias("truncated_rows"))


def batches(encoded: DataFrame, key: str, batch_size: int = 16, shards: int | None = None,
            rows_per_shard: int = 100_000) -> DataFrame:
    """Fixed-size training batches.  Rows are spread over ``shards`` by a
    hash of ``key`` (uniform, so no shard is hot), ordered inside a shard by
    the same hash, and cut into groups of ``batch_size``; the last batch of a
    shard may be short.  Each batch row stacks at most ``batch_size``
    arrays.  ``shards`` defaults to one per ``rows_per_shard`` rows, so a
    shard fits one task whatever the number of rows."""
    if shards is None:
        shards = max(1, -(-encoded.count() // rows_per_shard))
    h = F.md5(F.col(key).cast("string"))
    shard = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % shards).cast("int")
    w = Window.partitionBy("shard").orderBy("__h", key)
    ranked = (encoded.withColumn("__h", h).withColumn("shard", shard)
              .withColumn("batch", ((F.row_number().over(w) - 1) / batch_size).cast("long").cast("int")))
    rows = F.sort_array(F.collect_list(F.struct("__h", F.col(key).alias("k"), "input_ids",
                                                "attention_mask", "labels")))
    return (ranked.groupBy("shard", "batch").agg(rows.alias("__rows"))
            .select("shard", "batch",
                    F.col("__rows.k").alias("keys"),
                    F.col("__rows.input_ids").alias("input_ids"),
                    F.col("__rows.attention_mask").alias("attention_mask"),
                    F.col("__rows.labels").alias("labels")))


def render_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", template: str = CHAT_TEMPLATE) -> DataFrame:
    """One string per conversation: turns in order, each rendered with the
    role template, concatenated.  The output row is the conversation, so its
    turns are gathered (the result size is the input size)."""
    fields = {"role": role, "text": text}
    piece = F.concat(*[F.lit(p) if i % 2 == 0 else F.col(fields[p])
                       for i, p in enumerate(_split_template(template)) if p or i % 2])
    rendered = turns.select(conv, turn, piece.alias("__piece"))
    return (rendered.groupBy(conv)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(turn), F.col("__piece")))).alias("__t"))
            .select(conv, F.array_join(F.col("__t.__piece"), "").alias("chat"),
                    F.size("__t").alias("turns")))


def _split_template(template: str) -> list[str]:
    """``"a{role}b{text}c"`` -> ``["a", "role", "b", "text", "c"]``."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return parts

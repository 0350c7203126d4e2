"""Registered queries: vocabulary, encoding, labels, statistics, batches,
chat rendering (over the ``documents`` and ``conversations`` tables)."""

from __future__ import annotations


from ..operators import tokens
from ..sources.tables import table
from .queries_eval import round_doubles
from .registry import register

VOCAB_SIZE = 5000
MAX_LEN = 128
BATCH = 16
SHARD_ROWS = 125

_TOK = f"regexp_extract_all(coalesce(text, ''), '{tokens.TOKEN_PATTERN}')"
_SPECIALS_SQL = " union all ".join(
    f"select '{t}' as token, {i}::integer as id, 0::bigint as count" for i, t in enumerate(tokens.SPECIALS))
VOCAB_CTE = f"""
    select token, id, count from (
      select token, (row_number() over (order by count desc, token) + {len(tokens.SPECIALS) - 1})::integer as id,
             count
      from (select token, count(*) as count
            from (select unnest({_TOK}) as token from documents)
            where token not in ({", ".join(f"'{t}'" for t in tokens.SPECIALS)})
            group by token order by count desc, token limit {VOCAB_SIZE}))
    union all {_SPECIALS_SQL}"""

ENCODED_CTE = f"""
    select doc_id, lang, n_tokens, ids || list_transform(range({MAX_LEN} - len(ids)), lambda x: {tokens.EOS}) as input_ids,
           list_transform(range(len(ids)), lambda x: 1) || list_transform(range({MAX_LEN} - len(ids)), lambda x: 0)
               as attention_mask,
           ids || list_transform(range({MAX_LEN} - len(ids)), lambda x: -100) as labels
    from (select doc_id, lang, len(tok)::integer as n_tokens,
                 list_transform(tok[1:{MAX_LEN}], lambda t: coalesce(map_extract_value(m, t), {tokens.UNK})) as ids
          from (select doc_id, lang, {_TOK} as tok from documents),
               (select map_from_entries(list({{'k': token, 'v': id}})) as m from vocab))"""


def _vocab(spark, sf):
    return tokens.vocab(table(spark, sf, "documents"), "text", VOCAB_SIZE)


def _encoded(spark, sf):
    docs = table(spark, sf, "documents")
    return tokens.encode(docs, "text", _vocab(spark, sf), ["doc_id", "lang"], MAX_LEN)


@register("vocab", f"with vocab as ({VOCAB_CTE}) select * from vocab")
def vocab(spark, sf):
    return _vocab(spark, sf)


@register("encode", f"with vocab as ({VOCAB_CTE}), enc as ({ENCODED_CTE}) "
                    "select doc_id, n_tokens, input_ids, attention_mask, labels from enc")
def encode(spark, sf):
    return _encoded(spark, sf).select("doc_id", "n_tokens", "input_ids", "attention_mask", "labels")


@register("encode_collator_labels", f"with vocab as ({VOCAB_CTE}), enc as ({ENCODED_CTE}) "
          f"select doc_id, list_transform(input_ids, lambda x: case when x = {tokens.EOS} then -100 else x end)"
          " as labels from enc")
def encode_collator_labels(spark, sf):
    return tokens.collator_labels(_encoded(spark, sf)).select("doc_id", "labels")


@register("token_stats", f"with vocab as ({VOCAB_CTE}), enc as ({ENCODED_CTE}) "
          f"select lang, count(*) as rows, sum(least(n_tokens, {MAX_LEN}))::bigint as total_tokens,"
          f" round(avg(least(n_tokens, {MAX_LEN})), 6) as mean_tokens,"
          f" count(*) filter (where n_tokens > {MAX_LEN}) as truncated_rows from enc group by lang")
def token_stats(spark, sf):
    return round_doubles(tokens.token_stats(_encoded(spark, sf), "lang", MAX_LEN))


@register("batches", f"""with vocab as ({VOCAB_CTE}), enc as ({ENCODED_CTE}),
    r as (select *, md5(doc_id::varchar) as h,
                 (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % greatest(1, ((select count(*) from enc) + {SHARD_ROWS - 1}) // {SHARD_ROWS}))::integer as shard from enc),
    b as (select *, ((row_number() over (partition by shard order by h, doc_id) - 1) // {BATCH})::integer as batch
          from r)
    select shard, batch, list(doc_id order by h, doc_id) as keys,
           list(input_ids order by h, doc_id) as input_ids,
           list(attention_mask order by h, doc_id) as attention_mask,
           list(labels order by h, doc_id) as labels
    from b group by shard, batch""")
def batches(spark, sf):
    return tokens.batches(_encoded(spark, sf), "doc_id", BATCH, rows_per_shard=SHARD_ROWS)


@register("render_chat", """
    select conv_id, string_agg('<start_of_turn>' || role || chr(10) || text || '<end_of_turn>' || chr(10), ''
                               order by turn) as chat, count(*)::integer as turns
    from conversations group by conv_id""")
def render_chat(spark, sf):
    return tokens.render_chat(table(spark, sf, "conversations"))


def _split_token_stats_sql() -> str:
    from .oracle import with_views
    from .queries_prep import QA_SQL_CTE, SPLIT_SQL_CTE

    text = ("'<bos>Question: ' || question_title || chr(10) || question_body || chr(10) || 'Answer: ' "
            "|| answer || '<eos>'")
    return with_views(f"""
        select split, count(*) as rows, sum(least(n, {MAX_LEN}))::bigint as total_tokens,
               round(avg(least(n, {MAX_LEN})), 6) as mean_tokens,
               count(*) filter (where n > {MAX_LEN}) as truncated_rows
        from (select split, len(regexp_extract_all({text}, '{tokens.TOKEN_PATTERN}')) as n from sp)
        group by split""", "questions", "answers", extra={"qa": QA_SQL_CTE, "sp": SPLIT_SQL_CTE})


@register("split_token_stats", _split_token_stats_sql())
def split_token_stats(spark, sf):
    """Training texts of the prepared corpus: vocabulary learned on the
    train split, every split encoded, token statistics per split."""
    from pyspark.sql import functions as F

    from ..operators import prep
    from .queries_prep import split_df

    corpus = prep.render_training(split_df(spark, sf))
    v = tokens.vocab(corpus.filter(F.col("split") == "train"), "text", VOCAB_SIZE)
    enc = tokens.encode(corpus, "text", v, ["split"], MAX_LEN)
    return round_doubles(tokens.token_stats(enc, "split", MAX_LEN))

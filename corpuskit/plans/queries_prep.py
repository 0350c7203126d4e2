"""Registered queries: corpus preparation, HTML cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..operators import prep, split
from ..session import materialize
from ..sources import derived
from ..sources.tables import table
from .oracle import html_to_text_sql, unicode_trim_sql, with_views
from .registry import register

TEST, VAL, SEED = 0.14, 0.06, 42
HELD = TEST + VAL
VAL_FRAC = VAL / HELD


def qa_pairs_df(spark, sf):
    """Whole-table pairing (no top-N cap): every question and answer above
    the score cut."""
    return prep.load_qa_pairs(derived.questions(spark, sf), derived.answers(spark, sf),
                              min_score=5, max_samples=None)


def split_df(spark, sf):
    from .prepare import prepare_corpus

    return prepare_corpus(derived.questions(spark, sf), derived.answers(spark, sf), min_score=5,
                          max_samples=None, test_size=TEST, val_size=VAL, seed=SEED)


# --- SQL restatements -------------------------------------------------------
QA_SQL_CTE = f"""
    select question_title, question_body, question_score, answer, answer_score from (
        select {unicode_trim_sql('q.Title')} as question_title,
               {html_to_text_sql('q.Body')} as question_body,
               q.Score as question_score,
               {html_to_text_sql('a.Body')} as answer,
               a.Score as answer_score
        from answers a join questions q on a.ParentId = q.Id
        where a.Score > 5 and q.Score > 5)
    where length(answer) > 50 and length(question_body) > 10"""

SPLIT_SQL_CTE = f"""
    select qa.*, s.split from qa join (
        select question_title,
               case when rn <= n - ceil({HELD!r}::double * n) then 'train'
                    when rn <= n - ceil({VAL_FRAC!r}::double * ceil({HELD!r}::double * n)) then 'test'
                    else 'val' end as split
        from (select question_title,
                     row_number() over (order by md5('{SEED}:' || question_title), question_title) as rn,
                     count(*) over () as n
              from (select distinct question_title from qa))) s using (question_title)"""


def _qa_sql(body: str) -> str:
    return with_views(body, "questions", "answers", extra={"qa": QA_SQL_CTE})


def _split_sql(body: str) -> str:
    return with_views(body, "questions", "answers", extra={"qa": QA_SQL_CTE, "sp": SPLIT_SQL_CTE})


# --- queries ----------------------------------------------------------------
@register("score_filter", with_views("select Id, Title, Body, Score from questions where Score > 5",
                                     "questions"))
def score_filter(spark, sf):
    return prep.score_filter(derived.questions(spark, sf), 5)


@register("top_questions", with_views(
    "select Id, Title, Body, Score from questions where Score > 5 order by Score desc, Id limit 200",
    "questions"))
def top_questions(spark, sf):
    return prep.top_questions(prep.score_filter(derived.questions(spark, sf), 5), 200)


@register("trim_title", with_views(f"select Id, {unicode_trim_sql('Title')} as title from questions",
                                   "questions"))
def trim_title(spark, sf):
    return derived.questions(spark, sf).select("Id", prep.trim_title(F.col("Title")).alias("title"))


@register("qa_pairs", _qa_sql("select * from qa"))
def qa_pairs(spark, sf):
    return qa_pairs_df(spark, sf)


@register("clean_html", f"select page_id, {html_to_text_sql('html')} as text from pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


CLEAN_STATS_SQL = f"""
    select count(*) as rows_in, count_if(length(t) > 50)::bigint as rows_out,
           count_if(length(t) <= 50)::bigint as rows_dropped,
           coalesce(sum(length(html)), 0)::bigint as chars_before,
           coalesce(sum(length(t)), 0)::bigint as chars_after
    from (select html, {html_to_text_sql('html')} as t from pages)"""


@register("clean_stats", CLEAN_STATS_SQL)
def clean_stats(spark, sf):
    pages = table(spark, sf, "pages").withColumn("text", html_to_text(F.col("html")))
    return prep.clean_stats(pages, "html", "text", 50)


@register("clean_observed", CLEAN_STATS_SQL)
def clean_observed(spark, sf):
    """The same figures, observed while the cleaned pages are written."""
    pages = table(spark, sf, "pages").withColumn("text", html_to_text(F.col("html")))
    kept, seen = prep.observed_clean(pages, "html", "text", 50)
    materialize(kept.select("page_id", "text"), "clean-pages")
    told = seen.get
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


@register("render_prompt", _qa_sql(
    "select question_title, answer_score, 'Question: ' || question_title || chr(10) || question_body"
    " || chr(10) || 'Answer:' as prompt from qa"))
def render_prompt(spark, sf):
    return prep.render_prompt(qa_pairs_df(spark, sf)).select("question_title", "answer_score", "prompt")


@register("render_training", _qa_sql(
    "select question_title, answer_score, '<bos>Question: ' || question_title || chr(10) || question_body"
    " || chr(10) || 'Answer: ' || answer || '<eos>' as text from qa"))
def render_training(spark, sf):
    return prep.render_training(qa_pairs_df(spark, sf)).select("question_title", "answer_score", "text")


@register("distinct_titles", _qa_sql("select distinct question_title from qa"))
def distinct_titles(spark, sf):
    return split.distinct_titles(qa_pairs_df(spark, sf))


@register("grouped_split", _split_sql("select * from sp"))
def grouped_split(spark, sf):
    return split_df(spark, sf)


@register("hash_split", _qa_sql(f"""
    select *, case when f < {1.0 - HELD!r} then 'train' when f < {1.0 - HELD + TEST!r} then 'test'
                   else 'val' end as split
    from (select *, (('0x' || substr(md5('{SEED}:' || question_title), 1, 8))::bigint)::double
                    / 4294967296.0 as f from qa)""").replace("select *, case", "select question_title, question_body, question_score, answer, answer_score, case"))
def hash_split(spark, sf):
    return split.hash_split(qa_pairs_df(spark, sf), test_size=TEST, val_size=VAL, seed=SEED)


# The corpus in which every title is asked twice (the second time with another
# answer), as titles of a forum recur.
ASKED_AGAIN = "select * from qa union all select * replace (answer || ' (again)' as answer) from qa"
_ROW_SPLIT = "case when substr(md5(question_body || answer), 1, 1) < '8' then 'train' else 'test' end"


def _asked_again(df):
    return df.unionByName(df.withColumn("answer", F.concat("answer", F.lit(" (again)"))))


def _row_split(df):
    """A naive split that deals out single rows."""
    return df.withColumn("split", F.when(F.substring(F.md5(F.concat("question_body", "answer")), 1, 1) < "8", "train").otherwise("test"))


@register("split_leakage", _qa_sql(f"""
    select question_title, count(distinct s) as n_splits
    from (select question_title, {_ROW_SPLIT} as s from ({ASKED_AGAIN}))
    group by question_title having count(distinct s) > 1"""))
def split_leakage(spark, sf):
    """The audit, by whole title, of a split that leaks: rows are dealt out
    singly in a corpus whose titles recur."""
    return split.split_leakage(_row_split(_asked_again(qa_pairs_df(spark, sf))))


@register("split_title_leakage", _split_sql("""
    select question_title, count(distinct split) as n_splits from sp
    group by question_title having count(distinct split) > 1"""))
def split_title_leakage(spark, sf):
    """The audit over the split that is handed out, by whole title: no rows."""
    return split.split_leakage(split_df(spark, sf))


@register("naive_split_leakage", _qa_sql(f"""
    select question_title, count(distinct s) as n_splits
    from (select question_title, {_ROW_SPLIT} as s from qa)
    group by question_title having count(distinct s) > 1"""))
def naive_split_leakage(spark, sf):
    """The audit, by whole title, over a split that deals out single rows."""
    return split.split_leakage(_row_split(qa_pairs_df(spark, sf)))


@register("split_audit", _qa_sql(f"""
    select split, count(*) as rows, count(distinct question_title) as titles,
           count(distinct question_title) filter (where n > 1) as leaking_titles
    from (select *, count(distinct s) over (partition by question_title) as n, s as split
          from (select *, {_ROW_SPLIT} as s from ({ASKED_AGAIN})))
    group by split""".replace("count(distinct s) over (partition by question_title)", "(max(s) over (partition by question_title) <> min(s) over (partition by question_title))::integer + 1")))
def split_audit(spark, sf):
    """Per split: rows, titles, and titles that another split holds as well."""
    return split.split_audit(_row_split(_asked_again(qa_pairs_df(spark, sf))))


@register("split_preview", _split_sql("""
    select split, count(*) as rows,
           arg_min(substr(question_body, 1, 300), (md5(question_title), md5(answer))) as question_preview,
           arg_min(substr(answer, 1, 300), (md5(question_title), md5(answer))) as answer_preview
    from sp group by split"""))
def split_preview(spark, sf):
    return prep.split_preview(split_df(spark, sf))


@register("test_head", _split_sql("""
    select question_title, question_body, question_score, answer, answer_score, split from sp
    where split = 'test' order by md5(question_title), md5(answer), question_title, answer limit 100"""))
def test_head(spark, sf):
    return prep.test_head(split_df(spark, sf).filter(F.col("split") == "test"), 100)


@register("count_contract", with_views(
    "select n_pred, n_ref, n_pred = n_ref and n_ref > 0 as ok from"
    " (select count(*) as n_pred from answers), (select count(*) as n_ref from questions)",
    "questions", "answers"))
def count_contract(spark, sf):
    return prep.count_contract(derived.answers(spark, sf), derived.questions(spark, sf))


TOP_N = 200
TOP_QA_SQL_CTE = QA_SQL_CTE.replace(
    "join questions q on a.ParentId = q.Id",
    f"join (select * from questions where Score > 5 order by Score desc, Id limit {TOP_N}) q on a.ParentId = q.Id")


@register("prepared_top200", with_views("select * from sp", "questions", "answers",
                                         extra={"qa": TOP_QA_SQL_CTE, "sp": SPLIT_SQL_CTE}))
def prepared_top200(spark, sf):
    """The reference's default preparation: top 200 questions by score
    (the limit is the feature), their answers above the score cut, cleaned,
    filtered and split."""
    from .prepare import prepare_corpus

    return prepare_corpus(derived.questions(spark, sf), derived.answers(spark, sf), min_score=5,
                          max_samples=TOP_N, test_size=TEST, val_size=VAL, seed=SEED)


@register("pairing_stats", with_views(f"""
    select count(*) as pairs_in,
           count_if(length(answer) <= 50)::bigint as dropped_short_answer,
           count_if(length(body) <= 10)::bigint as dropped_short_body,
           count_if(length(answer) > 50 and length(body) > 10)::bigint as pairs_out,
           coalesce(sum(length(a_body)), 0)::bigint as answer_chars_before,
           coalesce(sum(length(answer)), 0)::bigint as answer_chars_after,
           coalesce(sum(length(q_body)), 0)::bigint as body_chars_before,
           coalesce(sum(length(body)), 0)::bigint as body_chars_after
    from (select a.Body as a_body, q.Body as q_body, {html_to_text_sql('a.Body')} as answer,
                 {html_to_text_sql('q.Body')} as body
          from answers a join questions q on a.ParentId = q.Id
          where a.Score > 5 and q.Score > 5)""", "questions", "answers"))
def pairing_stats(spark, sf):
    """Cleaning statistics of the pairing stage (both length predicates)."""
    q = prep.score_filter(derived.questions(spark, sf), 5)
    a = prep.score_filter(derived.answers(spark, sf), 5)
    return prep.pairing_stats(q, a)

"""Q&A corpus preparation: score filter, top-N, HTML cleaning, pairing,
length filter, prompt/training text rendering, previews and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.text import unicode_trim

QA_COLUMNS = ["question_title", "question_body", "question_score", "answer", "answer_score"]

def score_filter(df: DataFrame, min_score: int = 5, col: str = "Score") -> DataFrame:
    """Strict ``Score > min_score``; NULL scores are dropped.  Pushed down
    to the parquet scan when ``df`` is a scan."""
    return df.filter(F.col(col) > F.lit(min_score))


def top_questions(questions: DataFrame, n: int = 200) -> DataFrame:
    """Top ``n`` questions by score, ties by ``Id``.  Plans as
    TakeOrderedAndProject: each task keeps n rows, no full sort."""
    return questions.orderBy(F.col("Score").desc(), F.col("Id").asc()).limit(n)


def trim_title(col: Column) -> Column:
    """Strip all leading/trailing Unicode whitespace (``\\t``, ``\\n`` too)."""
    return unicode_trim(col)


def build_qa_pairs(questions: DataFrame, answers: DataFrame, *, min_answer_chars: int = 50,
                   min_body_chars: int = 10) -> DataFrame:
    """Join answers to their question (1:N inner equi-join on ParentId = Id),
    clean both bodies to text, trim the title, keep pairs whose cleaned
    answer has more than 50 and body more than 10 characters.

    Cleaning is written after the join so only paired answers are cleaned.
    AQE picks the join strategy from measured bytes and splits skewed
    ParentId partitions; a top-N of questions bounds rows, not bytes, so
    nothing is broadcast by plan.
    """
    q = questions.select(F.col("Id").alias("q_id"), F.col("Title").alias("q_title"),
                         F.col("Body").alias("q_body"), F.col("Score").alias("q_score"))
    a = answers.select(F.col("ParentId").alias("a_parent"), F.col("Body").alias("a_body"),
                       F.col("Score").alias("a_score"))
    joined = a.join(q, F.col("a_parent") == F.col("q_id"), "inner")
    pairs = joined.select(
        trim_title(F.col("q_title")).alias("question_title"),
        html_to_text(F.col("q_body")).alias("question_body"),
        F.col("q_score").alias("question_score"),
        html_to_text(F.col("a_body")).alias("answer"),
        F.col("a_score").alias("answer_score"),
    )
    # Optimizer barrier: a plain filter on the cleaned columns would be
    # pushed below the projection with the cleaning expressions inlined,
    # cleaning every text twice.  Filters cannot cross a generator on its
    # own output, so the one-element inline() keeps cleaning at once per row.
    pairs = pairs.select(F.inline(F.array(F.struct(*[F.col(c) for c in QA_COLUMNS]))))
    return pairs.filter((F.length("answer") > min_answer_chars)
                        & (F.length("question_body") > min_body_chars))


def load_qa_pairs(questions: DataFrame, answers: DataFrame, *, min_score: int = 5,
                  max_samples: int | None = 200) -> DataFrame:
    """Loader semantics: score filter on both tables, top-N questions
    (``max_samples=None`` keeps all), then :func:`build_qa_pairs`."""
    q = score_filter(questions.select("Id", "Title", "Body", "Score"), min_score)
    a = score_filter(answers.select("Id", "ParentId", "Body", "Score"), min_score)
    if max_samples is not None:
        q = top_questions(q, max_samples)
    return build_qa_pairs(q, a)


def render_prompt(df: DataFrame, title: str = "question_title", body: str = "question_body",
                  out: str = "prompt") -> DataFrame:
    """``Question: {title}\\n{body}\\nAnswer:`` (NULL parts render empty)."""
    return df.withColumn(out, F.concat(F.lit("Question: "), F.coalesce(F.col(title), F.lit("")),
                                       F.lit("\n"), F.coalesce(F.col(body), F.lit("")),
                                       F.lit("\nAnswer:")))


TRAINING_TEMPLATE = "<bos>Question: {title}\n{body}\nAnswer: {answer}<eos>"


def render_template(template: str, columns: dict[str, str]) -> Column:
    """Resolve ``{name}`` placeholders of a template to columns at plan time."""
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(F.col(columns[m.group(1)]), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def render_training(df: DataFrame, template: str = TRAINING_TEMPLATE, out: str = "text") -> DataFrame:
    """Training text with literal ``<bos>``/``<eos>`` markers."""
    cols = {"title": "question_title", "body": "question_body", "answer": "answer"}
    return df.withColumn(out, render_template(template, cols))


def split_preview(df: DataFrame, split_col: str = "split", chars: int = 300) -> DataFrame:
    """Rows per split plus the first ``chars`` characters of the body and
    answer of the split's first row (first by title hash, then answer hash)."""
    order = F.struct(F.md5("question_title"), F.md5("answer"))
    return (df.groupBy(split_col)
              .agg(F.count(F.lit(1)).alias("rows"),
                   F.min_by(F.substring("question_body", 1, chars), order).alias("question_preview"),
                   F.min_by(F.substring("answer", 1, chars), order).alias("answer_preview")))


def count_contract(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """One row ``(n_pred, n_ref, ok)``: prediction and reference counts must
    agree; and an empty corpus is flagged by ``n_ref = 0``."""
    tags = (predictions.select(F.lit(1).alias("__p"), F.lit(0).alias("__r"))
            .unionByName(references.select(F.lit(0).alias("__p"), F.lit(1).alias("__r"))))
    counts = tags.agg(F.coalesce(F.sum("__p"), F.lit(0)).cast("long").alias("n_pred"),
                      F.coalesce(F.sum("__r"), F.lit(0)).cast("long").alias("n_ref"))
    return counts.withColumn("ok", (F.col("n_pred") == F.col("n_ref")) & (F.col("n_ref") > 0))


def require_nonempty(df: DataFrame, message: str = "No Q&A pairs after filtering") -> DataFrame:
    """Raise when ``df`` has no rows (one ``LIMIT 1`` job)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def test_head(df: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows of a split in a reproducible order (title hash,
    then answer hash): the test set shared by every method."""
    return (df.orderBy(F.md5("question_title"), F.md5("answer"), "question_title", "answer")
              .limit(n))


def clean_stats(df: DataFrame, raw_col: str, clean_col: str, min_chars: int) -> DataFrame:
    """Cleaning statistics in one aggregate: rows in/out, characters before
    and after, rows the length predicate drops."""
    return (df.select(F.length(raw_col).alias("before"), F.length(clean_col).alias("after"))
            .agg(F.count(F.lit(1)).alias("rows_in"),
                 F.count_if(F.col("after") > min_chars).alias("rows_out"),
                 F.count_if(F.col("after") <= min_chars).alias("rows_dropped"),
                 F.coalesce(F.sum("before"), F.lit(0)).alias("chars_before"),
                 F.coalesce(F.sum("after"), F.lit(0)).alias("chars_after")))


def pairing_stats(questions: DataFrame, answers: DataFrame, *, min_answer_chars: int = 50,
                  min_body_chars: int = 10) -> DataFrame:
    """Cleaning statistics of the pairing stage in one aggregate: joined
    pairs, rows each length predicate drops, rows kept, and characters of
    answers and question bodies before and after cleaning."""
    q = questions.select(F.col("Id").alias("q_id"), F.col("Body").alias("q_body"))
    a = answers.select(F.col("ParentId").alias("a_parent"), F.col("Body").alias("a_body"))
    j = a.join(q, F.col("a_parent") == F.col("q_id"), "inner").select(
        "a_body", "q_body", html_to_text(F.col("a_body")).alias("answer"),
        html_to_text(F.col("q_body")).alias("body"))
    short_answer = F.length("answer") <= min_answer_chars
    short_body = F.length("body") <= min_body_chars
    return j.agg(
        F.count(F.lit(1)).alias("pairs_in"),
        F.count_if(short_answer).alias("dropped_short_answer"),
        F.count_if(short_body).alias("dropped_short_body"),
        F.count_if(~short_answer & ~short_body).alias("pairs_out"),
        F.coalesce(F.sum(F.length("a_body")), F.lit(0)).cast("long").alias("answer_chars_before"),
        F.coalesce(F.sum(F.length("answer")), F.lit(0)).cast("long").alias("answer_chars_after"),
        F.coalesce(F.sum(F.length("q_body")), F.lit(0)).cast("long").alias("body_chars_before"),
        F.coalesce(F.sum(F.length("body")), F.lit(0)).cast("long").alias("body_chars_after"))


def observed_clean(df: DataFrame, raw_col: str, clean_col: str, min_chars: int) -> tuple[DataFrame, Observation]:
    """The rows that :func:`clean_stats` counts as kept, and an observation
    that holds its figures once any action has run the returned table: the
    figures ride on the plan that does the work, with no second scan."""
    seen = Observation()
    after = F.length(clean_col)
    told = df.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(after > min_chars).alias("rows_out"), F.count_if(after <= min_chars).alias("rows_dropped"),
                      F.coalesce(F.sum(F.length(raw_col)), F.lit(0)).alias("chars_before"), F.coalesce(F.sum(after), F.lit(0)).alias("chars_after"))
    return told.where(after > min_chars), seen


def observed_contract(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference") -> tuple[DataFrame, Observation]:
    """Positionally paired rows (a full join, so either side may be null) with
    the counts of both sides observed as they pass: ``n_pred`` and ``n_ref``."""
    seen = Observation()
    return pairs.observe(seen, F.count(prediction).alias("n_pred"), F.count(reference).alias("n_ref")), seen


def check_contract(seen: Observation) -> dict:
    """The observed counts; raises if they differ or no reference passed."""
    told = seen.get
    if told["n_pred"] != told["n_ref"] or not told["n_ref"]:
        raise ValueError(f"{told['n_pred']} predictions for {told['n_ref']} references")
    return told

"""File sources and sinks: Q&A CSV dumps, prompt/answer JSONL, prediction
and reference files in the four accepted shapes, result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .csvsplits import read_csv_splits
from .jsonsplits import file_order, read_strings

QUESTIONS_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()), T.StructField("OwnerUserId", T.LongType()),
    T.StructField("CreationDate", T.StringType()), T.StructField("ClosedDate", T.StringType()),
    T.StructField("Score", T.IntegerType()), T.StructField("Title", T.StringType()),
    T.StructField("Body", T.StringType())])
ANSWERS_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()), T.StructField("OwnerUserId", T.LongType()),
    T.StructField("CreationDate", T.StringType()), T.StructField("ParentId", T.LongType()),
    T.StructField("Score", T.IntegerType()), T.StructField("Body", T.StringType())])

# Quoted multi-line HTML with doubled-quote escapes; whitespace is data.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "encoding": "UTF-8", "mode": "PERMISSIVE"}


def read_qa_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a Q&A CSV with an explicit schema (no inference pass).  A bad
    UTF-8 byte decodes to U+FFFD.  Spark's multi-line reader takes one task
    per file; :func:`read_qa_csv_splits` takes one per split."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def read_qa_csv_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of :func:`read_qa_csv` from any number of tasks per file."""
    return read_csv_splits(spark, path, schema, CSV_OPTIONS)


def write_qa_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**{k: v for k, v in CSV_OPTIONS.items()
                                          if k not in ("multiLine", "mode")}).csv(path)


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: T.StructType) -> DataFrame:
    read_qa_csv_splits(spark, src, schema).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


SAMPLE_SCHEMA = T.StructType([T.StructField("idx", T.LongType()), T.StructField("prompt", T.StringType()),
                              T.StructField("answer", T.StringType())])


def read_samples(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """Prompt/answer JSONL; ``num_samples`` keeps the first n by ``idx``, or by
    line where the file has no ``idx`` field."""
    df = spark.read.schema(SAMPLE_SCHEMA).json(path)
    if num_samples is None:
        return df
    if not _numbered(df, path):
        df = with_line_index(df.select("prompt", "answer"), "idx").select("idx", "prompt", "answer")
    return df.orderBy("idx").limit(num_samples)


def _numbered(df: DataFrame, path: str) -> bool:
    """Whether the rows have ``idx``; some with and some without is an error,
    as neither the given numbers nor line numbers would then be whole."""
    told = df.agg(F.count("idx").alias("with_idx"), F.count(F.lit(1)).alias("rows")).first()
    if 0 < told["with_idx"] < told["rows"]:
        raise ValueError(f"{path}: {told['with_idx']} of {told['rows']} rows have an idx")
    return told["with_idx"] > 0


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str, shape: str, parts: bool = False) -> DataFrame:
    """``(idx, text)`` from one of the accepted shapes:

    * ``"jsonl"``: one ``{"text": ...}`` per line (add ``idx`` to keep order
      across files; otherwise the line position within each file is used);
    * ``"responses"`` / ``"predictions"``: one JSON object holding a list;
    * ``"array"``: a JSON array of strings.
    The three whole-document shapes are single JSON values, read by one
    task per file and exploded; JSONL splits and is the format for scale.
    With ``parts`` the files of a folder are together one document, as
    :func:`write_list` leaves it, and are read by splits.
    """
    if parts and shape != "jsonl":
        return read_predictions_splits(spark, path, shape, parts)
    if shape == "jsonl":
        df = spark.read.schema("idx long, text string").json(path)
        if _numbered(df, path):
            return df
        return with_line_index(df.select("text"), "idx").select("idx", "text")
    if shape in ("responses", "predictions"):
        df = spark.read.schema(f"{shape} array<string>").option("multiLine", "true").json(path)
        if df.filter(F.col(shape).isNotNull()).isEmpty():
            raise ValueError(f"{path} has no {shape!r} list")
        return df.select(F.posexplode(shape).alias("idx", "text")).select(F.col("idx").cast("long"), "text")
    if shape == "array":
        txt = spark.read.text(path, wholetext=True)
        arr = F.from_json("value", T.ArrayType(T.StringType()))
        return txt.select(F.posexplode(arr).alias("idx", "text")).select(F.col("idx").cast("long"), "text")
    raise ValueError(f"unknown shape {shape!r}")


def read_predictions_splits(spark: SparkSession, path: str, shape: str, parts: bool = False) -> DataFrame:
    """The rows of :func:`read_predictions` for the whole-document shapes, by
    any number of tasks per document."""
    if shape not in ("responses", "predictions", "array"):
        raise ValueError(f"unknown shape {shape!r}")
    return read_strings(spark, path, None if shape == "array" else shape, parts)


def with_line_index(df: DataFrame, out: str = "idx") -> DataFrame:
    """Consecutive 0-based line numbers in file order (path up to the first
    digit of the file's name, that number, the name; then the position in the
    file, so ``part-100000`` follows ``part-99999``) without a global sort.

    Rows are tagged with their file, the start of the file split they were
    read from, and their position in the task.  One small row per split
    (count, first position) gets a running offset in that order and is joined
    back (AQE broadcasts it if it is small), and every row's number is its
    split's offset plus its position inside the split.  File
    splits are deterministic, so both passes see the same splits.  ``df``
    must be a file scan (optionally projected or filtered).
    """
    from pyspark.sql import Window

    tagged = (df.withColumn("__file", F.input_file_name())
                .withColumn("__blk", F.input_file_block_start())
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    splits = tagged.groupBy("__pid", "__file", "__blk").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first"))
    offsets = splits.select("__pid", "__file", "__blk", "__first", F.coalesce(F.sum("__n").over(
        Window.orderBy(*file_order("__file"), "__blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (tagged.join(offsets, ["__pid", "__file", "__blk"])
                  .withColumn(out, (F.col("__off") + F.col("__pos") - F.col("__first")).cast("long"))
                  .drop("__pid", "__file", "__blk", "__pos", "__first", "__off"))


def write_list(texts: DataFrame, path: str, order: list[str], text: str, head: str, tail: str) -> None:
    """One JSON document: ``head``, the strings of ``text`` in ``order`` (equal
    ones by text; nulls first), ``tail``, each value on a line of its own.

    The document is cut into parts between lines, one per task of a sort by
    range, so no task holds the whole list: the files of ``path``, put together
    in the order of their names, are the document.  A small one is one file.
    """
    # equal keys meet in one task: the head is there with the first value, the tail with the last
    key = F.struct(*order, F.substring(text, 1, 64).alias("__start"))
    rows = materialize(texts.select(key.alias("key"), F.col(text).alias("text")), "list")
    ends = rows.agg(F.min("key").alias("first"), F.max("key").alias("last"))
    no_text = F.lit(None).cast("string").alias("text")
    lines = (rows.select(F.lit(1).alias("section"), "key", "text")
             .union(ends.select(F.lit(0), "first", no_text)).union(ends.select(F.lit(2), "last", no_text)))
    lines = (lines.repartitionByRange("key").sortWithinPartitions("section", "key", "text")
             .select("section", F.to_json(F.array("text")).alias("list"), F.monotonically_increasing_id().alias("n")))  # 0 the head, 1 the first value
    value = F.expr("substring(list, 2, length(list) - 2)")
    line = (F.when(F.col("section") == 0, F.lit(head)).when(F.col("section") == 2, F.lit(tail))
            .when(F.col("n") == 1, value).otherwise(F.concat(F.lit(","), value)))
    lines.select(line.alias("value")).write.mode("overwrite").text(path)


def write_evaluation(metrics: DataFrame, responses: DataFrame, path: str, order: str = "idx", text: str = "text") -> None:
    """One JSON document ``{"metrics": {...}, "responses": [...]}`` from a
    one-row table and the responses in ``order``, in parts as
    :func:`write_list` cuts it."""
    told = metrics.select(F.to_json(F.struct("*")).alias("json")).limit(2).collect()
    if len(told) != 1:
        raise ValueError("metrics must be one row")
    write_list(responses, path, [order], text, f'{{"metrics":{told[0]["json"]},"responses":[', "]}")


def read_evaluation_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The metrics, as ``schema``, of a document by :func:`write_evaluation`:
    its first line, closed."""
    head = spark.read.text(path).where(F.col("value").startswith('{"metrics":'))
    return head.select(F.from_json(F.concat("value", F.lit("]}")), f"metrics struct<{schema}>").alias("d")).select("d.metrics.*")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False) -> None:
    """Result sink.  ``single_file`` is for one-row-per-method reports only;
    corpus outputs keep their partitioning."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)

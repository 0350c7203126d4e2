"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import named, table
from corpuskit.llm.decontaminate import decontaminate
from corpuskit.llm.linededup import dedup_lines
from corpuskit.llm.neardup import near_duplicates
from corpuskit.llm.packing import pack
from corpuskit.llm.quality import judge
from corpuskit.session import materialize

WORD = "[^\\x20\\x09-\\x0D]"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_key) is in ``gone``."""
    keys = gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    judged = judge(docs, docs.columns).where("kept").select("doc")
    return judged.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so does a document that has no word left
    by that.  ``n_chars`` follows the new text."""
    deduped = dedup_lines(docs).where((F.col("lines_gone") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        deduped = deduped.withColumn("n_chars", F.when(F.col("lines_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return deduped.select(*named(docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (least id) of every group of near-duplicates."""
    told = near_duplicates(docs).groupBy("doc_id", "text_key").agg(F.max("first").alias("first"), F.count("*").alias("rows"))
    told = materialize(told, "near-decisions")
    rest = _without(docs, told.where(~F.col("first")))
    # of rows equal in id and text, one stays
    twins = told.where("first and rows > 1")
    if twins.isEmpty():
        return rest
    single = _without(rest, twins)
    return single.unionByName(rest.join(twins.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "text"]))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, judged.where("contaminated").select("doc_id", "text_key").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 1024."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024, end_id=2)


STAGES = [("quality", quality), ("line dedup", lines), ("near-duplicates", near), ("decontamination", clean), ("packing", packed)]
ORACLE_SQL = None  # sketches aside, signatures and packing have no SQL form; tests/llm holds the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs

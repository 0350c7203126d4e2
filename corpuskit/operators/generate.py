"""Batch generation over a prompt table with a user-supplied model.

``generate`` is a factory returning a callable ``list[str] -> list[str]``;
it is called once per partition (a model is loaded once per task), then
prompts go through it ``batch_size`` at a time.  Latency per sample is the
batch's wall time divided by the batch size.  Arrow batches bound the
memory per task (``spark.sql.execution.arrow.maxRecordsPerBatch``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


ModelFactory = Callable[[], Callable[[list[str]], list[str]]]


def truncate_words(text: str, max_new_tokens: int) -> str:
    """Cut an output at ``max_new_tokens`` whitespace words."""
    words = text.split()
    return text if len(words) <= max_new_tokens else " ".join(words[:max_new_tokens])


def batch_generate(prompts: DataFrame, generate: ModelFactory | dict[str, ModelFactory], *,
                   key: str = "idx", prompt: str = "prompt", method: str | None = None,
                   carry: list[str] = (), batch_size: int = 16, max_new_tokens: int = 128, profile=None) -> DataFrame:
    """Rows ``key, [method,] [carry...,] response, latency, num_tokens``.

    With ``method`` set, ``generate`` maps each method name to its factory
    and every method is a column value of one job (not a loop of jobs).
    ``profile`` is a Spark resource profile for the stage that runs the model
    (executors with accelerators, say), where the cluster supports it.
    """
    keep = [key] + ([method] if method else []) + list(carry)
    fields = [f for f in prompts.select(*keep).schema.fields]
    schema = T.StructType(fields + [T.StructField("response", T.StringType()),
                                    T.StructField("latency", T.DoubleType()),
                                    T.StructField("num_tokens", T.IntegerType())])
    factories = generate if isinstance(generate, dict) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict = {}
        for pdf in batches:
            groups = [(None, pdf)] if not method else list(pdf.groupby(method, sort=False, dropna=False))
            for name, part in groups:
                name = None if pd.isna(name) else name
                if name not in models:
                    models[name] = (factories[name] if factories else generate)()
                model = models[name]
                for start in range(0, len(part), batch_size):
                    chunk = part.iloc[start:start + batch_size]
                    t0 = time.perf_counter()
                    outs = model(chunk[prompt].fillna("").tolist())
                    elapsed = time.perf_counter() - t0
                    outs = [truncate_words(o, max_new_tokens) for o in outs]
                    res = chunk[keep].copy()
                    res["response"] = outs
                    res["latency"] = elapsed / max(len(chunk), 1)
                    res["num_tokens"] = [len(o.split()) for o in outs]
                    yield res

    more = {"profile": profile} if profile is not None else {}
    return prompts.select(*keep, prompt).mapInPandas(run, schema, **more)


def finished(spark: SparkSession, ledger: str, keys: list[str]) -> DataFrame | None:
    """The keys whose responses the ledger holds; None if there is no ledger."""
    try:
        return spark.read.parquet(ledger).select(*keys)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def resume_generate(prompts: DataFrame, generate: ModelFactory | dict[str, ModelFactory], ledger: str, *, key: str = "idx",
                    method: str | None = None, waves: int = 8, **how) -> DataFrame:
    """:func:`batch_generate` that goes on where a failed run stopped.

    Finished rows lie in ``ledger``, a parquet folder on storage that all
    executors share.  Prompts whose key (and method) it holds are left out by an
    anti-join; the others are dealt by hash into ``waves``, each of which is one
    job that appends its rows when it is whole.  So a crash loses one wave at
    most, no prompt is answered twice by runs that follow each other, and after
    success every prompt has exactly one response.  Keys must be unique (per
    method); prompts with a null key are refused.  Returns the whole ledger.
    """
    spark, keys = prompts.sparkSession, [key, *([method] if method else [])]
    if not prompts.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"a prompt without {key}")
    for wave in range(waves):
        due = prompts.where(F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(waves)) == wave)
        done = finished(spark, ledger, keys)
        if done is not None:
            # null-safe: a method may be null
            left, right = due.alias("due"), done.alias("done")
            match = [F.col(f"due.{k}").eqNullSafe(F.col(f"done.{k}")) for k in keys]
            due = left.join(right, match, "left_anti")
        if done is None or not due.isEmpty():
            batch_generate(due, generate, key=key, method=method, **how).write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)

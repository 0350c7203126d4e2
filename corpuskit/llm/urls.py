"""URL filtering by a sorted digest array.

The listed strings (here rules, written ``host/path``) are sorted by their
64-bit xxhash and written to the shared folder as shards of three arrays:
keys, offsets into the strings, and the strings.  A task memory-maps the
shards, probes all candidates of a batch with one vectorised binary search,
and confirms each hit against the stored string, so a digest collision never
decides.

A rule fits its host and all subdomains, if the path starts with the rule's
path; the longest rule wins (then the smaller string).  A url with no rule
gets the default verdict.  Null url, or one without ``://``: empty host and
path, so only a rule of an empty host could fit: the default.
"""

from __future__ import annotations

import functools
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import materialize, scratch_path

SHARD_ROWS = 4_000_000  # listed strings in a shard: 32 MB of keys


def _digest(strings: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


def _write_shard(batches, out: str):
    from pyarrow import fs as pfs
    from pyspark import TaskContext

    task, parts = TaskContext.get(), []
    for batch in batches:
        parts += batch.column("listed").to_pylist()
    if not parts:
        return
    parts = [p.encode() for p in sorted(set(parts))]
    keys = _digest(parts)
    order = np.argsort(keys, kind="stable")
    fs, root = pfs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
    strings = [parts[k] for k in order]
    offsets = np.cumsum([0, *map(len, strings)]).astype("<i8")
    for kind, data in (("keys", keys[order].astype("<u8").tobytes()), ("offsets", offsets.tobytes()), ("strings", b"".join(strings))):
        with fs.open_output_stream(f"{root}/{name}.{kind}") as sink:
            sink.write(data)
    yield pa.record_batch([pa.array([f"{out}/{name}"]), pa.array([len(strings)])], names=["shard", "rows"])


def build_digest_array(listed: DataFrame) -> list[str]:
    """Write ``listed`` (one string column, ``listed``) as shards; returns
    their paths (a shard holds up to SHARD_ROWS strings, so the driver sees
    one path per millions of strings)."""
    spark = listed.sparkSession
    out = scratch_path(spark, "digests")
    n = listed.count()
    shards = max(1, -(-n // SHARD_ROWS))
    written = listed.select("listed").where("listed is not null").repartition(shards, "listed").mapInArrow(functools.partial(_write_shard, out=out), "shard string, rows long")
    return [r["shard"] for r in materialize(written, "digest-shards").collect()]


def _mapped(path: str) -> str:
    """A local path of a shared file: itself, or a copy made once per worker."""
    from pyarrow import fs as pfs

    fs, inner = pfs.FileSystem.from_uri(path)
    if fs.type_name == "local":
        return inner
    local = os.path.join(tempfile.mkdtemp(), os.path.basename(inner))
    with fs.open_input_stream(inner) as src, open(local, "wb") as dst:
        while block := src.read(1 << 20):
            dst.write(block)
    return local


@functools.lru_cache(maxsize=64)
def _shard(path: str):
    load = lambda kind, dtype: np.memmap(name, dtype, "r") if os.path.getsize(name := _mapped(f"{path}.{kind}")) else np.zeros(0, dtype)
    return load("keys", "<u8"), load("offsets", "<i8"), load("strings", "u1")


def probe(shards: list[str], candidates: list[bytes]) -> np.ndarray:
    """Which candidates are listed, by digest and then by the full string."""
    found = np.zeros(len(candidates), bool)
    wanted = _digest(candidates)
    for path in shards:
        keys, offsets, strings = _shard(path)
        lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        for k in np.flatnonzero(hi > lo):
            found[k] |= any(strings[offsets[j]:offsets[j + 1]].tobytes() == candidates[k] for j in range(lo[k], hi[k]))
    return found


def _judge(batches, shards: list[str], path_lengths: list[int], labels: int):
    for batch in batches:
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        owner, candidates = [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            names = host.split(".")
            heads = {path[:n] for n in path_lengths if n <= len(path)}
            for k in range(max(0, len(names) - labels), len(names)):
                tail = ".".join(names[k:])
                for head in heads:
                    owner.append(row)
                    candidates.append(f"{tail}{head}")
        # each distinct candidate of the batch is probed once
        distinct, slot = np.unique(np.array(candidates, object), return_inverse=True) if candidates else (np.zeros(0, object), np.zeros(0, int))
        hit = probe(shards, [c.encode() for c in distinct])[slot]
        best: list[str | None] = [None] * batch.num_rows
        for k in np.flatnonzero(hit):
            row, rule = owner[k], candidates[k]
            if best[row] is None or (-len(rule), rule) < (-len(best[row]), best[row]):
                best[row] = rule
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string())], names=[*batch.schema.names, "rule"])


def url_parts(url) -> tuple:
    """(host, path) expressions of a url column."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``rules``: (verdict, ``host/path``) pairs, or a DataFrame of verdict, rule.
    A rule that is listed twice takes ``block``.
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules) or [], "verdict string, rule string")
    rules = materialize(rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict")), "url-rules")
    shards = build_digest_array(rules.select(F.col("rule").alias("listed")))
    # distinct lengths of rule paths, and most host labels: a few small numbers
    shape = rules.select(F.length(F.regexp_replace("rule", r"^[^/]*", "")).alias("n"), F.size(F.split(F.regexp_extract("rule", r"^([^/]*)", 1), r"\.")).alias("k")).distinct().collect()
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judge = functools.partial(_judge, shards=shards, path_lengths=sorted({r["n"] for r in shape}), labels=max((r["k"] for r in shape), default=0))
    kind = parts.schema["page_id"].dataType.simpleString()
    judged = parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string")
    return judged.join(rules, "rule", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

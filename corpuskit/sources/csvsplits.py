"""Scan of multi-line CSV files by splits.

Spark reads a CSV file whose quoted fields hold line feeds with one task,
since only the quotes before a place tell whether a line feed there ends a
record.  Here every file is read as lines (any number of byte ranges, from any
store that Spark reads), in three narrow passes:

1. the quotes of each split are counted; running sums over the splits of a file
   (one small row each) tell which splits begin inside a quoted field;
2. lines are put together to records; what a split's first record continues and
   its last record leaves open is handed on as a fragment, and the fragments of
   one record, over however many splits, are joined in order;
3. every record is parsed by Spark's CSV parser with the given schema.

Texts are never shuffled, but for the fragments (at most two per split).  The
splits known to begin inside a field are sent to the tasks as 8 bytes each: at
one split per 128 MB that is 6 MB for 100 TB.

Quotes must only stand around fields, doubled inside (RFC 4180).  Line feeds
end records outside of quotes, with or without a carriage return before.  Empty
lines are no records; a bad UTF-8 byte becomes U+FFFD.  Every file starts with
a header, which is skipped; an empty file or folder gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, split, value): physical lines with the split they lie in."""
    file, block = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(file.alias("file"), block.alias("block"), F.xxhash64(file, block).alias("split"), F.make_valid_utf8("value").alias("value"))


def split_quotes(lines: DataFrame) -> DataFrame:
    """(file, block, split, inside): whether the split begins in a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counted = lines.groupBy("file", "block", "split").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "block", "split", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _joined(lines: pa.Array, ends: np.ndarray, held: list[str]) -> list[str]:
    """Records that end at the given lines; the first continues what is held."""
    offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), lines.slice(0, int(ends[-1]) + 1))
    out = pc.binary_join(lists, "\n").to_pylist()
    if held:
        out[0] = "\n".join([*held, out[0]])
    return out


def _assemble(batches: Iterator[pa.RecordBatch], inside, fragments: bool) -> Iterator[pa.RecordBatch]:
    """Whole records of each split, or only its fragments: (file, block, nth,
    starts, header, record), nth 0 for the one at the split's start."""
    known = inside.value

    def rows(records: list[str], file: int, block: int, nth: int, starts: bool, header: bool) -> pa.RecordBatch:
        n = len(records)
        return pa.record_batch([pa.array([file] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([nth] * n, pa.int32()), pa.array([starts] * n), pa.array([header] * n), pa.array(records, pa.string())],
                               names=["file", "block", "nth", "starts", "header", "record"])

    now = file = block = None
    open_, carried, header, held = False, False, False, []

    def leave() -> Iterator[pa.RecordBatch]:
        # an open record goes on in the next split
        if held and fragments:
            yield rows(["\n".join(held)], file, block, 0 if carried else 1, not carried, header)
        elif held and not open_:
            yield rows(["\n".join(held)], file, block, 1, True, header)

    for batch in batches:
        splits = batch.column("split").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(splits)) + 1).tolist(), len(splits)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi == lo:
                continue
            part = batch.slice(lo, hi - lo)
            if splits[lo] != now:
                if now is not None:
                    yield from leave()
                now, file, block, held = splits[lo], part.column("file")[0].as_py(), part.column("block")[0].as_py(), []
                at = np.searchsorted(known, now)
                open_ = carried = bool(at < len(known) and known[at] == now)
                header = block == 0 and not carried
            lines = part.column("value")
            after = (int(open_) + np.cumsum(pc.count_substring(lines, QUOTE).to_numpy())) % 2
            ends = np.flatnonzero(after == 0)
            if len(ends):
                records = _joined(lines, ends, held)
                if carried:  # the rest of a record of an earlier split
                    if fragments:
                        yield rows(records[:1], file, block, 0, False, False)
                    records, carried = records[1:], False
                elif header:
                    records, header = records[1:], False
                if not fragments and records:
                    yield rows(records, file, block, 1, True, False)
                held = lines.slice(int(ends[-1]) + 1).to_pylist()
            else:
                held = held + lines.to_pylist()
            open_ = bool(after[-1])
    if now is not None:
        yield from leave()


_ROWS = "file long, block long, nth int, starts boolean, header boolean, record string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every CSV record but the headers."""
    lines = _lines(spark, path)
    first = split_quotes(lines).where("inside")
    inside = spark.sparkContext.broadcast(np.sort(np.array([r["split"] for r in first.select("split").toLocalIterator()], np.int64)))
    whole = lines.mapInArrow(functools.partial(_assemble, inside=inside, fragments=False), _ROWS).select("record")
    parts = lines.mapInArrow(functools.partial(_assemble, inside=inside, fragments=True), _ROWS)
    order = Window.partitionBy("file").orderBy("block", "nth")
    parts = parts.withColumn("nr", F.sum(F.col("starts").cast("long")).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "record"))), lambda x: x["record"])
    stitched = parts.groupBy("file", "nr").agg(F.array_join(texts, "\n").alias("record"), F.max("header").alias("header")).where("not header").select("record")
    return whole.union(stitched).select(F.regexp_replace("record", "\r$", "").alias("record")).where("record != ''")


def read_csv_splits(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The rows of :func:`files.read_qa_csv`, in many tasks per file."""
    kept = {k: v for k, v in options.items() if k not in ("header", "multiLine", "encoding")}
    parsed = read_records(spark, path).select(F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), kept).alias("r"))
    return parsed.select("r.*")

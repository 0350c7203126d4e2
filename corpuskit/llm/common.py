"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # text bytes that one step of a Python task holds at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of ``column`` (one row
    at least), so that memory does not follow Spark's rows per batch."""
    for batch in batches:
        n, at = batch.num_rows, 0
        size = max(1, batch.column(column).nbytes // max(n, 1))
        step = max(1, limit // size)
        while at < n:
            part = batch.slice(at, step)
            while part.num_rows > 1 and part.column(column).nbytes > 2 * limit:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def named(columns: list[str]) -> list:
    """Columns by their plain names, whatever characters those hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_bitmap(keys: DataFrame, column: str, bits: int) -> bytes:
    """Bits of a long column modulo ``bits`` (a power of two).  At most
    ``bits`` / 32768 rows of 4 KB reach the driver, whatever the input."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1  # the bitmap functions count from 1
    out = bytearray(bits // 8)
    for r in keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toLocalIterator():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["bits"]
    return bytes(out)


def in_bitmap(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys have their bit set (no false negative)."""
    bits = np.frombuffer(bitmap, np.uint8)
    slot = (keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)

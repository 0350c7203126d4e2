"""Best-two-fit packing of token ids into fixed-size training sequences.

1. Each whole text is encoded once; a text of more than ``max_tokens`` ids is
   cut into pieces, its first piece taking the remainder.  The pieces are
   written to the shared folder, each with its rank among the equal lengths of
   its task.
2. The only thing that the driver sees is how many pieces have each length
   (at most ``max_tokens`` numbers).  :func:`plan_bins` packs those counts: it
   fills a bin greedily (largest length that fits), then replaces the bin's
   smallest piece by two unpacked ones that fit the expanded gap more tightly,
   and repeats such a bin as often as the counts allow.
3. A piece finds its place by (length, rank): one join with the plan, whose
   size is bounded by ``max_tokens`` and not by the number of documents.

Null text: an empty one (only the end id).  Null, repeated and extra columns
do no harm: rows are never matched by ``doc_id``.  No document: no row.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import in_slices
from corpuskit.llm.encoding import ENCODE_BYTES, encoder
from corpuskit.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"
OFFSETS_BROADCAST_ROWS = 200_000  # of (task, length) counts; beyond it they are shuffled


def _cut(batches, tokenizer: str, max_tokens: int, end_id: int):
    encode = encoder(tokenizer).encode
    part, seen = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
    for batch in in_slices(batches, "text", ENCODE_BYTES):
        ids, off = encode(batch.column("text"))
        n = np.diff(off) + 1
        flat = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4")
        count = -(-n // max_tokens)
        first = n - (count - 1) * max_tokens
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        length = np.where(piece == 0, first[row], max_tokens)
        start = np.where(piece == 0, 0, first[row] + (piece - 1) * max_tokens)
        # rank among this task's pieces of the same length
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        run = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        nth = np.empty(len(order), np.int64)
        nth[order] = run
        nth += seen[length]
        seen += np.bincount(length, minlength=max_tokens + 1)
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
        yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), blob.cast(pa.binary()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)],
                              names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])


def encode_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit), and its task and rank among that task's equal lengths."""
    cut = functools.partial(_cut, tokenizer=tokenizer, max_tokens=max_tokens, end_id=end_id)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _best_pair(room: int, least: int, left: np.ndarray, at_most: np.ndarray) -> tuple[int, int] | None:
    """Two available lengths with the largest sum in (least, room]."""
    a = np.flatnonzero(left[:room])
    if not len(a):
        return None
    b = at_most[room - a]
    alone = (b == a) & (left[a] < 2)
    b = np.where(alone, at_most[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    k = int(total.argmax())
    return (int(a[k]), int(b[k])) if least < total[k] <= room else None


def plan_bins(counts: dict[int, int], max_tokens: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), by best-two-fit over counts."""
    left = np.zeros(max_tokens + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    axis, plan = np.arange(max_tokens + 1), []
    while left.any():
        whole = left.copy()

        def fits(room: int) -> int:
            have = np.flatnonzero(left[:room + 1])
            return int(have[-1]) if len(have) else 0

        held, gap = [], max_tokens
        while gap and (best := fits(gap)):
            held.append(best)
            left[best] -= 1
            gap -= best
        while gap and len(held) > 1:
            least = min(held)
            at_most = np.maximum.accumulate(np.where(left > 0, axis, 0))
            pair = _best_pair(gap + least, least, left, at_most)
            if pair is None:
                break
            held.remove(least)
            held += pair
            left[least] += 1
            for x in pair:
                left[x] -= 1
            gap = max_tokens - sum(held)
        uses = Counter(held)
        times = min(int(whole[x]) // n for x, n in uses.items())
        left = whole
        for x, n in uses.items():
            left[x] -= n * times
        plan.append((held, times))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of every slot."""
    used, sequence, rows = Counter(), 0, []
    for held, times in plan:
        offset = 0
        for length in held:
            rows.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces with their ids and place: doc_id, piece, start, length, ids,
    sequence_id (from 0, gapless) and offset (gapless in each sequence)."""
    spark = docs.sparkSession
    pieces = materialize(encode_pieces(docs, tokenizer, max_tokens, end_id), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    per_task = materialize(per_task, "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(_slots(plan_bins(counts, max_tokens)), "length long, lo long, hi long, seq long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if per_task.count() <= OFFSETS_BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = pieces.join(base, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids", (F.col("seq") + F.col("nth") - F.col("lo")).alias("sequence_id"), "offset")

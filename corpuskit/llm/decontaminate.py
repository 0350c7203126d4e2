"""Benchmark decontamination by winnowing.

Words are runs of letters and digits, A-Z lower-cased.  A benchmark window is
13 consecutive words of an item, or the whole of a shorter one.  Of every
window of L words the least hash of its k-grams (k = 7, or L if shorter) is its
fingerprint, so a shared window always shares a fingerprint.

1. Benchmark: distinct windows (as text) with their items, and fingerprints.
2. Documents, one pass: fingerprints of all windows, kept where a bitmap of the
   benchmark's fingerprints (fixed size, no false negatives) has them, each
   with the words of the windows that it stands for.
3. Fingerprints are joined with the benchmark's; the hits are extended to their
   windows, which are joined by their text, so no hash collision decides.

Null text: no words.  Repeated or null ids do no harm: rows are matched by a
row number.  Items with a null id count as one item named ``null``.  No
benchmark: nothing is contaminated.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import in_bitmap, in_slices, key_bitmap
from corpuskit.llm.textwords import ALNUM, Words, grams, window_minima
from corpuskit.session import materialize

WINDOW, GRAM = 13, 7
BITMAP_BITS = 1 << 24  # 2 MB, whatever the benchmark's size
SPAN = np.uint64(0x9E3779B97F4A7C15)  # keeps fingerprints of different window lengths apart

ITEM = "item_id string, windows array<struct<n: int, words: string>>, prints array<long>"
SCAN = "row long, doc_id long, text_key long, n_words long, hits array<struct<print: long, n: int, at: long, count: int, words: string>>"


def _prints(words: Words, hashes: np.ndarray, length: int):
    """(start of every window of ``length`` words, place of its fingerprint's
    gram, fingerprint), over all texts."""
    k = min(GRAM, length)
    values = grams(hashes, k)
    place = window_minima(values, length - k + 1)
    # windows that lie within one text
    n = len(place)
    inside = np.zeros(n, bool)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        inside[lo:max(lo, hi - length + 1)] = True
    start = np.flatnonzero(inside)
    place = place[start]
    with np.errstate(over="ignore"):
        return start, place, values[place] + SPAN * np.uint64(length)


def _items(batches, window: int):
    for batch in in_slices(batches, "text"):
        words = Words(batch.column("text"), ALNUM)
        hashes = words.hashes()
        windows, prints = [], []
        of = {n: _prints(words, hashes, n) for n in {min(window, int(x)) for x in np.diff(words.first) if x}}
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            n = min(window, hi - lo)
            if not n:
                windows.append([])
                prints.append([])
                continue
            start, _, value = of[n]
            a, b = np.searchsorted(start, [lo, hi - n + 1])
            windows.append([{"n": n, "words": words.text(s, s + n)} for s in start[a:b].tolist()])
            prints.append(np.unique(value[a:b]).view(np.int64).tolist())
        kind = pa.list_(pa.struct([("n", pa.int32()), ("words", pa.string())]))
        yield pa.record_batch([batch.column("item_id"), pa.array(windows, kind), pa.array(prints, pa.list_(pa.int64()))], names=["item_id", "windows", "prints"])


def _scan(batches, bitmap, lengths: list[int]):
    row = TaskContext.get().partitionId() << 36
    kind = pa.list_(pa.struct([("print", pa.int64()), ("n", pa.int32()), ("at", pa.int64()), ("count", pa.int32()), ("words", pa.string())]))
    for batch in in_slices(batches, "text"):
        words = Words(batch.column("text"), ALNUM)
        hashes = words.hashes()
        hits: list[list] = [[] for _ in range(batch.num_rows)]
        for n in lengths:
            start, place, value = _prints(words, hashes, n)
            held = np.flatnonzero(in_bitmap(bitmap.value, value))
            # neighbouring windows with one gram as fingerprint make one hit
            start, place, value = start[held], place[held], value[held]
            text = np.searchsorted(words.first, start, "right") - 1
            head = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1) | (np.diff(text) != 0)])) if len(start) else held
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(start)]):
                s, t = int(start[a]), int(text[a])
                hits[t].append({"print": int(value[a:a + 1].view(np.int64)[0]), "n": n, "at": s - int(words.first[t]), "count": b - a, "words": words.text(s, s + b - a - 1 + n)})
        yield pa.record_batch([pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(words.first)), pa.array(hits, kind)], names=["row", "doc_id", "text_key", "n_words", "hits"])
        row += batch.num_rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: row (a number of its own), doc_id, text_key (xxhash64 of the
    text), n_words, n_hit (words
    inside an occurrence of a benchmark window), items (sorted ids, as strings)
    and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    spark = docs.sparkSession
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    items = materialize(named.mapInArrow(functools.partial(_items, window=window), ITEM), "bench-items")
    owned = items.select("item_id", F.explode("windows").alias("w")).select("item_id", F.col("w.n").alias("n"), F.col("w.words").alias("words")).distinct()
    prints = items.select(F.explode("prints").alias("print")).distinct()
    lengths = sorted(r["n"] for r in owned.select("n").distinct().collect())

    bitmap = spark.sparkContext.broadcast(key_bitmap(prints, "print", BITMAP_BITS))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    scanned = materialize(texts.mapInArrow(functools.partial(_scan, bitmap=bitmap, lengths=lengths), SCAN), "doc-prints")
    hits = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(prints, "print", "left_semi")
    spread = hits.select("row", "n", F.split("words", " ").alias("w"), "at", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    found = spread.select("row", (F.col("at") + F.col("i")).alias("lo"), (F.col("at") + F.col("i") + F.col("n")).alias("hi"), F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("words"))
    windows = owned.select("words").distinct()
    found = materialize(found.join(windows, "words", "left_semi"), "bench-hits")

    spans = F.array_sort(F.collect_set(F.struct("lo", "hi")))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(
        F.greatest(a["upto"], s["hi"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(a["upto"], s["lo"]))).alias("n")), lambda a: a["n"])
    covered = found.groupBy("row").agg(covered.alias("n_hit"))
    named = found.select("row", "words").distinct().join(owned, "words").select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (scanned.select("row", "doc_id", "text_key", "n_words").join(covered.join(named, "row"), "row", "left")
            .select("row", "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated")))

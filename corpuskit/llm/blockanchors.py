"""Removal of repeated word passages with fixed-block anchors.

A word goes if it lies in a window of ``length`` (13) words that also starts in
a document with a smaller doc_id.

1. Reference blocks: every text is cut into non-overlapping blocks of 7 words
   (7 + 6 = 13: each window holds exactly one whole block of its own text, at
   any alignment).  Their hashes are the index.
2. Probes: the rolling 7-word windows of every text are looked up in the index;
   a hit on another place is an anchor.  A text's own blocks are hits if the
   index has them twice, or if another text's probe met them.
3. Extension: an anchor is extended to the windows around it, and these are
   matched as a whole (96-bit hash) with the least doc_id they start in.
   Neighbouring matched windows make the maximal repeats.

Lookups go through Bloom filters of a fixed size, which have no false negative:
a chance hit only adds windows that the match of step 3 then drops.  No pair of
places is ever formed.  A task first matches its own windows: one that a smaller
doc_id of the same task has is settled there, and of each other window the task
sends one row with its starts.  So a passage shared by very many documents
reaches the shuffle once per task, and no key is hot.  Equal texts are one class
and only its least document goes through; the others repeat it wholly.

Null or empty text: no words.  Fewer than ``length`` words: nothing removed.  A
row without doc_id neither removes nor loses words.  Rows of equal doc_id do
not remove each other's words.  Very long texts are cut in Arrow pieces by
their bytes; one text's windows are one row's work.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import in_bitmap, in_slices, partitions
from corpuskit.llm.spelled import joined, spelled_words
from corpuskit.llm.textwords import grams, mix
from corpuskit.session import materialize

LENGTH = 13
BITS = 1 << 28       # of the index's Bloom filter (32 MB); the other four have an eighth of them each
PROBES = 3           # bits of a key in it
HELD = 1 << 21       # windows that a task matches together

_WINDOWS = "doc_id long, key1 long, w1 long, w2 int, starts array<int>, settled boolean"
_CUT = "doc_id long, n_words long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary"
_SALTS = [0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B]


def _bits_of(keys: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(keys + np.uint64(salt)) for salt in _SALTS[:PROBES]]


def _filled(batches, bits: int):
    """The task's Bloom filter, in pieces of 4 KB that hold a bit."""
    own = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for slot in _bits_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
            slot = (slot & np.uint64(bits - 1)).astype(np.int64)
            for r in range(8):
                own[slot[(slot & 7) == r] >> 3] |= np.uint8(1 << r)
    pieces = own.reshape(-1, 4096)
    some = np.flatnonzero(pieces.any(axis=1))
    for at in range(0, len(some), 512):
        part = some[at:at + 512]
        yield pa.record_batch([pa.array(part), pa.array([x.tobytes() for x in pieces[part]], pa.binary())], names=["piece", "bits"])


def _bloom(keys: DataFrame, bits: int) -> bytes:
    """A Bloom filter of a long column.  At most ``bits`` / 32768 rows of 4 KB
    reach the driver; few tasks fill it, since each sends up to all of it."""
    out = np.zeros(bits // 8, np.uint8)
    few = max(4, partitions(keys.sparkSession) // 32)
    pieces = keys.coalesce(few).mapInArrow(functools.partial(_filled, bits=bits), "piece long, bits binary").groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits"))
    for r in pieces.toLocalIterator():
        out[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _in_bloom(bloom: bytes, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for bit in _bits_of(keys):
        some = np.flatnonzero(out)
        out[some] = in_bitmap(bloom, bit[some])
    return out


def _within(values: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start places of k words that stay in one text, number per text)."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return first[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts), text


def _blocks(batches, block: int):
    """The index entries of every text: hashes of its reference blocks."""
    for batch in in_slices(batches, "text"):
        words, _ = spelled_words(batch.column("text"))
        first, values = words.first, grams(words.hashes(), block)
        at, text = _within(values, first, block)
        own = (at - first[text]) % block == 0
        counts = np.bincount(text[own], minlength=len(first) - 1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values[at[own]].view(np.int64)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("key1"), batch.column("key2"), pa.array(np.diff(first)), lists], names=["doc_id", "key1", "key2", "n_words", "blocks"])


def _anchors(values: np.ndarray, first: np.ndarray, block: int, index, twice):
    """(places of all block-long windows, their texts, is a reference block, is an anchor)."""
    at, text = _within(values, first, block)
    own = (at - first[text]) % block == 0
    hit = _in_bloom(index, values[at])
    hit[own] = _in_bloom(twice, values[at[own]])
    return at, text, own, hit


def _going(batches, heads):
    for batch in in_slices(batches, "text"):
        batch = batch.filter(pa.array(_in_bloom(heads, batch.column("need_key").to_numpy().view(np.uint64))))
        if batch.num_rows:
            yield batch


def _probes(batches, block: int, heads, index, twice):
    """Hashes of the rolling windows that hit a reference block."""
    told = np.zeros(0, np.uint64)
    for batch in _going(batches, heads.value):
        words, _ = spelled_words(batch.column("text"))
        values = grams(words.hashes(), block)
        at, _, own, hit = _anchors(values, words.first, block, index.value, twice.value)
        keys = np.unique(values[at[hit & ~own]])
        keys = keys[~np.isin(keys, told)]  # what this task has told lately
        told = np.union1d(told, keys) if len(told) < 1 << 18 else keys
        yield pa.record_batch([pa.array(keys.view(np.int64))], names=["print"])


def _matched(doc, key, start, one, two):
    """Rows of _WINDOWS for the windows that a task holds together."""
    order = np.lexsort((start, key, doc, two, one))
    doc, key, start, one, two = doc[order], key[order], start[order], one[order], two[order]
    new = np.ones(len(doc), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    settled = doc > least
    row = new.copy()
    row[1:] |= (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    head = np.flatnonzero(row)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([head, [len(doc)]]), pa.int32()), pa.array(start, pa.int32()))
    # in order of the documents, whose columns are then small on disk
    back = pa.array(np.lexsort((start[head], key[head], doc[head])))
    rows = pa.record_batch([pa.array(doc[head]), pa.array(key[head]), pa.array(one[head].view(np.int64)), pa.array(two[head].view(np.int32)), lists, pa.array(settled[head])],
                           names=["doc_id", "key1", "w1", "w2", "starts", "settled"])
    return rows.take(back)


def _windows(batches, block: int, length: int, heads, index, twice, met):
    """The windows around every anchor, matched within the task."""
    held, n = [], 0
    for batch in _going(batches, heads.value):
        words, _ = spelled_words(batch.column("text"))
        first, hashes = words.first, words.hashes()
        values = grams(hashes, block)
        at, text, own, hit = _anchors(values, first, block, index.value, twice.value)
        hit[own] |= _in_bloom(met.value, values[at[own]])
        at, text = at[hit], text[hit]
        lo = np.maximum(at - (length - block), first[text])
        hi = np.minimum(at, first[text + 1] - length)
        lo, hi = lo[hi >= lo], hi[hi >= lo]
        mark = np.bincount(lo, minlength=len(words) + 1) - np.bincount(hi + 1, minlength=len(words) + 1)
        start = np.flatnonzero(np.cumsum(mark)[:-1])
        if not len(start):
            continue
        text = np.searchsorted(first, start, "right") - 1
        doc, key = batch.column("doc_id").to_numpy()[text], batch.column("key1").to_numpy()[text]
        held.append((doc, key, (start - first[text]).astype(np.int32), grams(hashes, length)[start], (grams(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), length)[start] >> np.uint64(32)).astype(np.uint32)))
        n += len(start)
        if n >= HELD:
            yield _matched(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield _matched(*map(np.concatenate, zip(*held)))


def _cut(batches, length: int):
    for batch in in_slices(batches, "text"):
        words, raw = spelled_words(batch.column("text"))
        first, starts = words.first, batch.column("starts")
        gone = np.zeros(len(words) + 1, np.int64)
        for t, (mine, whole) in enumerate(zip(starts.to_pylist(), batch.column("whole").to_pylist())):
            if whole and first[t + 1] - first[t] >= length:
                gone[first[t]] += 1
                gone[first[t + 1]] -= 1
            elif mine:
                s = first[t] + np.array(mine)
                np.add.at(gone, s, 1)  # a text's starts may come more than once
                np.add.at(gone, s + length, -1)
        stay = np.cumsum(gone)[:-1] == 0
        upto = np.concatenate([[0], np.cumsum(stay)])[first]
        kept = joined(raw, words.start[stay], words.end[stay], np.diff(upto))
        edge = np.diff(np.concatenate([[1], stay.astype(np.int8), [1]]))
        lo, hi = np.flatnonzero(edge[:-1] == -1), np.flatnonzero(edge == 1)
        # a run of removed words ends with its text
        cuts = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))]
        inner = np.unique(cuts[(~stay[cuts]) & (~stay[cuts - 1])]) if len(cuts) else cuts
        lo, hi = np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))
        text = np.searchsorted(first, lo, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(lo - first[text]), pa.array(hi - first[text])], ["lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(first))), pa.int32()), spans)
        n = np.diff(first)
        yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(upto)), lists, pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def _touched(batches, touched):
    for batch in batches:
        yield batch.filter(pa.array(_in_bloom(touched.value, batch.column("key1").to_numpy().view(np.uint64))))


def _untouched(batches, length: int, touched):
    for batch in batches:
        batch = batch.filter(pa.array(~_in_bloom(touched.value, batch.column("key1").to_numpy().view(np.uint64))))
        n = batch.num_rows
        if n:
            none, no = pa.nulls(n, pa.list_(pa.int32())), pa.array(np.zeros(n, bool))
            yield from _cut([pa.record_batch([batch.column("doc_id"), batch.column("text"), none, no], names=["doc_id", "text", "starts", "whole"])], length)


def remove_passages(docs: DataFrame, length: int = LENGTH, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (maximal removed runs of
    words, end exclusive) and kept (the other words, one space between)."""
    spark, block = docs.sparkSession, (length + 1) // 2
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("key1", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(length), "text"))
    named = texts.where("doc_id is not null")
    index = materialize(named.mapInArrow(functools.partial(_blocks, block=block), "doc_id long, key1 long, key2 long, n_words long, blocks array<long>"), "blocks").where(F.col("n_words") >= length)

    # the least document of each class of equal texts goes on
    classes = materialize(index.groupBy("key1", "key2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")), "classes")
    heads = classes.select(F.col("least").alias("doc_id"), "key1", "key2")
    entries = index.join(heads, ["doc_id", "key1", "key2"], "left_semi").dropDuplicates(["doc_id", "key1", "key2"]).select(F.explode("blocks").alias("print"))
    often = materialize(entries.groupBy("print").count().where("count > 1").select("print"), "repeated-blocks")
    share = lambda df, size: spark.sparkContext.broadcast(_bloom(df, size))
    known = {"heads": share(heads.select(F.xxhash64("doc_id", "key1")), bits // 8), "index": share(index.select(F.explode("blocks").alias("print")), bits), "twice": share(often, bits // 8)}
    keyed = named.select("doc_id", "key1", F.xxhash64("doc_id", "key1").alias("need_key"), "text")
    met = materialize(keyed.mapInArrow(functools.partial(_probes, block=block, **known), "print long"), "met")
    places = materialize(keyed.mapInArrow(functools.partial(_windows, block=block, length=length, met=share(met, bits // 8), **known), _WINDOWS), "windows")

    # at most one row of a window and task is left to match
    least = F.min("doc_id").over(Window.partitionBy("w1", "w2"))
    again = places.where("not settled").withColumn("least", least).where("doc_id > least").select("doc_id", "key1", "starts")
    again = again.union(places.where("settled").select("doc_id", "key1", "starts")).groupBy("doc_id", "key1").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    again = materialize(again, "repeated-starts")
    copies = classes.where("least < last").select("key1", "key2", "least")
    # only texts that may lose words are shuffled, to meet their starts
    touched = share(again.select("key1").union(copies.select("key1")), bits // 8)
    rest = texts.select("doc_id", "key1", "text").mapInArrow(functools.partial(_untouched, length=length, touched=touched), _CUT)
    held = texts.mapInArrow(functools.partial(_touched, touched=touched), texts.schema)
    told = held.join(again, ["doc_id", "key1"], "left").join(copies, ["key1", "key2"], "left")
    told = told.select("doc_id", "text", "starts", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("whole"))
    return told.mapInArrow(functools.partial(_cut, length=length), _CUT).union(rest)

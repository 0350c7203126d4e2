"""Exact removal of long repeated byte strings, by a column-wise construction.

Only places that can repeat are sorted.  Of every 200-byte string, the least
hash of its 64-byte grams is its anchor, so equal strings have the same anchor
at the same distance.  Neighbouring strings with one anchor make a segment;
segments whose anchor occurs once in the collection are done.

The other segments are dealt out by anchor and aligned at it.  A task then
builds the order of all their suffixes column by column, from the last column
to the first: each round inserts one symbol of every segment, by a stable sort
of the symbols that precede the suffixes sorted so far (the transform of the
collection restricted to one column, as only aligned suffixes can be equal),
and updates the common prefixes of neighbours.  Symbols lie column after column
in a scratch file that is read once in sequence.  Neighbours with 200 common
symbols are repeats.

Equal texts are told by their 128-bit hash first (one of them goes on), and
equal segments likewise, so a group of copies never gathers in a task.  An
anchor with more than ``HOT`` different segments is split into its single
strings, which are counted by a grouped aggregate.

Null text: empty.  Texts of fewer than 200 bytes: nothing removed.  Rows are
matched by their text, so null or repeated ids do no harm.
"""

from __future__ import annotations

import functools
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import in_bitmap, in_slices, key_bitmap, partitions
from corpuskit.llm.encoding import utf8
from corpuskit.llm.textwords import mix
from corpuskit.session import materialize

LENGTH, GRAM = 200, 64
HOT = 50_000             # different segments of one anchor that one task may sort
CHUNK = 1 << 17          # string starts looked at together
PLACE_BITS = 20          # a chunk and its overlap fit in so many
TEXT_BITS, ANCHOR_BITS = 1 << 26, 1 << 27

PRINTS = "key1 long, key2 long, need_key long, n_bytes long, anchors array<long>"
SEGMENTS = "key1 long, key2 long, first long, count int, anchor long, left int, content binary, bytes binary"


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k bytes (k a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h, factor, span = raw.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while span < k:
            h = h[:-span] * factor + h[span:]
            factor, span = factor * factor, span * 2
    return mix(h)


def segments(raw: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(text, first start, number of starts, anchor place, anchor hash) of all
    segments; places are within ``raw``."""
    width, found = length - gram + 1, []
    place = np.arange(CHUNK + length, dtype=np.uint64)
    backward = (np.uint64((1 << PLACE_BITS) - 1) - place)  # of equal hashes, the later place is less
    for at in range(0, len(raw) - length + 1, CHUNK):
        block = raw[at:at + CHUNK + length - 1]
        hashes = _gram_hashes(block, gram)
        low = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | backward[:len(hashes)]
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        anchor = ((1 << PLACE_BITS) - 1 - (low & np.uint64((1 << PLACE_BITS) - 1))).astype(np.int64)
        start = np.arange(len(anchor))
        text = np.searchsorted(off, at + start, "right") - 1
        inside = at + start + length <= off[text + 1]
        start, text, anchor = start[inside], text[inside], anchor[inside]
        if not len(start):
            continue
        head = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
        count = np.diff(np.concatenate([head, [len(start)]]))
        found.append((text[head], at + start[head], count, at + anchor[head], hashes[anchor[head]]))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _prints(batches, length: int, gram: int):
    for batch in in_slices(batches, "text"):
        raw, off = utf8(batch.column("text"))
        text, _, _, _, anchor = segments(raw, off, length, gram)
        ends = np.searchsorted(text, np.arange(len(off)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(anchor.view(np.int64)))
        yield pa.record_batch([batch.column("key1"), batch.column("key2"), batch.column("need_key"), pa.array(np.diff(off)), lists], names=["key1", "key2", "need_key", "n_bytes", "anchors"])


def _segments(batches, length: int, gram: int, texts, anchors):
    import xxhash

    told: set[bytes] = set()
    for batch in in_slices(batches, "text"):
        batch = batch.filter(pa.array(in_bitmap(texts.value, batch.column("need_key").to_numpy())))
        if not batch.num_rows:
            continue
        raw, off = utf8(batch.column("text"))
        text, first, count, place, anchor = segments(raw, off, length, gram)
        keep = np.flatnonzero(in_bitmap(anchors.value, anchor))
        text, first, count, place, anchor = text[keep], first[keep], count[keep], place[keep], anchor[keep]
        data, left = raw.tobytes(), (place - first).astype(np.int32)
        contents, blobs = [], []
        for a, n, lf in zip(first.tolist(), count.tolist(), left.tolist()):
            piece = data[a:a + n + length - 1]
            c = xxhash.xxh3_128_digest(piece, seed=lf)
            contents.append(c)
            blobs.append(None if c in told else piece)  # a task tells a content once
            told.add(c)
        if len(told) > 500_000:
            told.clear()
        rows = pa.array(text)
        yield pa.record_batch([batch.column("key1").take(rows), batch.column("key2").take(rows), pa.array(first - off[text]), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(left),
                               pa.array(contents, pa.binary()), pa.array(blobs, pa.binary())], names=["key1", "key2", "first", "count", "anchor", "left", "content", "bytes"])


def repeated_columns(pieces: np.ndarray, left: np.ndarray, size: np.ndarray, length: int, scratch: str) -> np.ndarray:
    """For aligned segments (row i of ``pieces`` holds ``size[i]`` bytes, its
    anchor at ``left[i]``): which starts repeat in another segment, as a
    (segment, start) array."""
    n, most = len(left), int(left.max(initial=0))
    right = size - left                      # columns at and after the anchor
    width = most + int(right.max(initial=0))
    columns = np.memmap(os.path.join(scratch, "columns"), np.uint8, "w+", shape=(width, n))
    for at in range(0, n, 4096):
        rows = np.zeros((min(4096, n - at), width), np.uint8)
        for k, i in enumerate(range(at, at + len(rows))):
            rows[k, most - left[i]:most - left[i] + size[i]] = pieces[i, :size[i]]
        columns[:, at:at + len(rows)] = rows.T
    begin, end = most - left, most + right   # the columns that a segment has
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
    marks = np.zeros((n, int((size - length).max(initial=0)) + 1), bool)
    entering = np.argsort(-end, kind="stable")
    ends = end[entering]
    at = 0
    for c in range(width - 1, -1, -1):
        # segments whose first column was passed leave; neighbours close up
        stay = np.flatnonzero(begin[order] <= c)
        if len(stay) < len(order):
            if len(stay):
                common = np.minimum.reduceat(common, np.concatenate([[0], stay[:-1] + 1]))
                common[0] = 0
            else:
                common = common[:0]
            order = order[stay]
        upto = at + int(np.searchsorted(-ends[at:], -c, "left")) if at < n else at  # those with end = c + 1
        if upto > at:
            order = np.concatenate([entering[at:upto], order])
            common = np.concatenate([np.zeros(upto - at, np.int32), common])
            common[:upto - at + 1] = 0
            at = upto
        if not len(order):
            continue
        symbol = columns[c][order]
        step = np.argsort(symbol, kind="stable")
        symbol = symbol[step]
        between = np.minimum.reduceat(np.append(common, np.int32(0)), step + 1) if len(step) else common
        common = np.zeros(len(step), np.int32)
        common[1:] = np.where(symbol[1:] == symbol[:-1], between[:-1] + 1, 0)
        order = order[step]
        if c <= most:
            long = common >= length
            again = long.copy()
            again[:-1] |= long[1:]
            which = order[again]
            start = c - begin[which]
            marks[which, start] = True
    columns._mmap.close()
    os.remove(os.path.join(scratch, "columns"))
    return marks


def _repeats(batches, length: int):
    """Repeated starts of every different content of the task's anchors."""
    with tempfile.TemporaryDirectory() as scratch:
        spool = open(os.path.join(scratch, "pieces"), "wb")
        most, seen, contents, left, size = 2 * length, set(), [], [], []
        for batch in batches:
            for content, lf, data in zip(batch.column("content").to_pylist(), batch.column("left").to_pylist(), batch.column("bytes").to_pylist()):
                if content not in seen:
                    seen.add(content)
                    contents.append(content)
                    left.append(lf)
                    size.append(len(data))
                    spool.write(data.ljust(most, b"\0"))
        spool.close()
        if not contents:
            return
        pieces = np.memmap(os.path.join(scratch, "pieces"), np.uint8, "r", shape=(len(contents), most))
        marks = repeated_columns(pieces, np.array(left, np.int64), np.array(size, np.int64), length, scratch)
        for at in range(0, len(contents), 10_000):
            some = marks[at:at + 10_000]
            edge = np.diff(np.pad(some, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            yield pa.record_batch([pa.array(contents[at:at + 10_000], pa.binary()).take(pa.array(row)), pa.array(lo), pa.array(hi)], names=["content", "lo", "hi"])


def _cut(batches):
    for batch in in_slices(batches, "text"):
        kept, removed, spans = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data, at, out, n = (text or "").encode(), 0, [], 0
            for run in runs or ():
                out.append(data[at:run["lo"]])
                at = run["hi"]
                n += run["hi"] - run["lo"]
            out.append(data[at:])
            kept.append(b"".join(out))
            removed.append(n)
            spans.append(len(runs or ()))
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), batch.column("spans"), pa.array(kept, pa.binary())],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def _merged(runs):
    """Overlapping and touching runs of a sorted array as one."""
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(done, run):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], run["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] >= run["lo"]), joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, empty, add)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (maximal
    removed byte runs, end exclusive) and kept (the other bytes)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key1", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(length), "text"))
    keyed = texts.select("key1", "key2", F.xxhash64("doc_id", "key1").alias("need_key"), "text")
    prints = materialize(keyed.mapInArrow(functools.partial(_prints, length=length, gram=gram), PRINTS), "anchors").where(F.col("n_bytes") >= length)

    # one of each group of equal texts goes on; all of a larger group is repeated
    distinct = materialize(prints.groupBy("key1", "key2").agg(F.min("need_key").alias("need_key"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")), "distinct-texts")
    going = prints.join(distinct.select("key1", "key2", "need_key"), ["key1", "key2", "need_key"], "left_semi")
    often = going.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor")
    often = materialize(often, "repeated-anchors")
    share = lambda data: spark.sparkContext.broadcast(data)
    find = functools.partial(_segments, length=length, gram=gram, texts=share(key_bitmap(distinct, "need_key", TEXT_BITS)), anchors=share(key_bitmap(often, "anchor", ANCHOR_BITS)))
    places = materialize(keyed.mapInArrow(find, SEGMENTS), "segments")

    told = places.where("bytes is not null").select("anchor", "left", "content", "bytes")
    crowded = materialize(told.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot-anchors")
    sorted_here = told.join(crowded, "anchor", "left_anti").repartition(partitions(spark), "anchor")
    runs = sorted_here.mapInArrow(functools.partial(_repeats, length=length), "content binary, lo long, hi long")
    # a hot anchor: its strings one by one, counted by content
    single = told.join(crowded, "anchor", "left_semi").dropDuplicates(["content"])
    single = single.select("anchor", "content", F.col("left").alias("l"), "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("lo"))
    single = single.select("anchor", "content", (F.col("l") - F.col("lo")).alias("shift"), "lo", F.unhex(F.md5(F.substring("bytes", F.col("lo") + 1, F.lit(length)))).alias("string"))
    more = single.groupBy("anchor", "shift", "string").count().where("count > 1").select("anchor", "shift", "string")
    single = single.join(more, ["anchor", "shift", "string"], "left_semi").select("content", F.col("lo").cast("long").alias("lo"), (F.col("lo") + 1).cast("long").alias("hi"))
    # contents at several places repeat as a whole
    whole = places.groupBy("content").agg(F.count("*").alias("n"), F.first("count").alias("hi")).where("n > 1").select("content", F.lit(0).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    runs = materialize(runs.union(single).union(whole), "repeated-runs")

    found = places.select("key1", "key2", "first", "content").join(runs, "content").select("key1", "key2", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") - 1 + length).alias("hi"))
    copied = distinct.where("copies > 1").select("key1", "key2", F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi"))
    found = found.join(copied, ["key1", "key2"], "left_anti").union(copied)
    spans = found.groupBy("key1", "key2").agg(_merged(F.array_sort(F.collect_set(F.struct("lo", "hi")))).alias("spans"))
    joined = texts.join(spans, ["key1", "key2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary")

"""Periodic runs of words by catching squares online with dyadic blocks.

Words are appended one after the other.  Whenever a block of 2^k words (aligned
within its text) is complete, it becomes a *catcher*: it listens to the next
appended words for its own copy at a distance p of 2 to 4 block lengths (1 to 3
for single words).  A square of such a period has a first half of two block
lengths or more, which holds a whole aligned block, so every square is caught
on the level of its period, and each level costs two comparisons per appended
word.  A copy is then grown in both directions by comparing suffixes and
prefixes (64-bit names of blocks, longest first); if it covers a square, the
maximal stretch is reported.  Stretches of one place are the same run, seen
with multiples of its period: the least one stays.

A level's catchers are rows and the words appended while they listen are
columns of one comparison, for all texts of a batch at once; a text of n words
takes O(n log n) steps and 8 log2(n) bytes a word.  Texts are never compared
with each other.

Null, empty or wordless text: no run.  Repeated rows and null ids do no harm
(every row is judged by itself).
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import in_slices, named
from corpuskit.llm.spelled import joined, spelled_words
from corpuskit.llm.textwords import mix

CELLS = 1 << 22  # comparisons of catchers and words that are looked at together

RUN = "struct<start:long,length:long,period:long>"


class _Names:
    """64-bit names of all blocks of 1, 2, 4, ... consecutive words."""

    def __init__(self, words: np.ndarray):
        self.levels = [mix(words)]

    def __getitem__(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, len(low) - half)
            with np.errstate(over="ignore"):
                self.levels.append(mix(low[:n] * np.uint64(0x9E3779B97F4A7C15) + low[half:half + n] + np.uint64(len(self.levels))))
        return self.levels[k]

    def common(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, top: int, back: bool) -> np.ndarray:
        """Equal words before (``back``) or from the places i and j, at most ``room``."""
        got, k = np.zeros(len(i), np.int64), top
        while k >= 0:
            name, width = self[k], 1 << k
            some = np.flatnonzero(got + width <= room)
            step = -got[some] - width if back else got[some]
            same = some[name[i[some] + step] == name[j[some] + step]]
            got[same] += width
            if k < top or not len(same):
                k -= 1  # the widest block is tried again while it fits
        return got


def catch_runs(words: np.ndarray, first: np.ndarray, exponent: int = 2, least: int = 2):
    """(start, end, period) of all maximal stretches of ``exponent`` periods or
    more and ``least`` words or more, in order; ``words`` are 64-bit values of
    all texts, text t has ``first[t]:first[t + 1]``."""
    names, begin, size = _Names(words), first[:-1], np.diff(first)
    found, k = [], 0
    while True:
        width = 1 << k
        near, far = (1, 4) if k == 0 else (2 * width, 4 * width)
        # catchers: completed blocks that may lie in the first period of a run
        listen = np.where(size >= max(least, exponent * near), (size - width - (exponent - 1) * near) // width + 1, 0).clip(0)
        if not listen.any():
            break
        text = np.repeat(np.arange(len(size)), listen)
        place = begin[text] + width * (np.arange(len(text)) - np.repeat(np.cumsum(listen) - listen, listen))
        stop, name, period = first[text + 1], names[k], np.arange(near, far)
        starts, periods, texts = [], [], []
        for at in range(0, len(place), max(1, CELLS // len(period))):
            rows = slice(at, at + max(1, CELLS // len(period)))
            s, e = place[rows, None], stop[rows, None]
            heard = name[np.minimum(s + period, len(name) - 1)] == name[place[rows]][:, None]
            heard &= s + (exponent - 1) * period + width <= e
            r, p = np.nonzero(heard)
            r, p = r + at, p + near
            for times in range(2, exponent):  # later copies, which a run of so many periods has
                again = name[place[r] + times * p] == name[place[r]]
                r, p = r[again], p[again]
            starts.append(place[r])
            periods.append(p)
            texts.append(text[r])
        s, p, t = np.concatenate(starts), np.concatenate(periods), np.concatenate(texts)
        # neighbouring catchers with one distance are in the same stretch: the first tells it
        order = np.lexsort((s, p))
        s, p, t = s[order], p[order], t[order]
        head = np.ones(len(s), bool)
        head[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + width) | (t[1:] != t[:-1])
        s, p, t = s[head], p[head], t[head]
        if len(s):
            top = int(size[t].max()).bit_length() - 1
            ahead = names.common(s, s + p, first[t + 1] - s - p, top, False)
            behind = names.common(s, s + p, s - first[t], top, True)
            start, end = s - behind, s + p + ahead
            keep = (end - start >= exponent * p) & (end - start >= least)
            found.append(np.stack([start[keep], end[keep], p[keep]]))
        k += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def periodic_tail(doc_id, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, the words of every tenth document repeat with
    period p (by the CRC-32 of its digits); None: the text as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _runs_of(batches, exponent: int, least: int, tail, carry: list[str]):
    for batch in in_slices(batches, "text"):
        words, raw = spelled_words(batch.column("text"))
        first = words.first
        at = np.arange(len(words))
        if tail is not None:
            for t, doc in enumerate(batch.column("tail_key").to_pylist()):
                lo, n = int(first[t]), int(first[t + 1] - first[t])
                told = tail(doc, n)
                if told is not None:
                    a, p = told
                    at[lo + a:lo + n] = lo + a + np.arange(n - a) % p
        hashes = words.hashes()[at]
        start, end, period = catch_runs(hashes, first, exponent, least)
        gone = np.zeros(len(at) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, end, -1)
        stay = np.cumsum(gone)[:-1] == 0
        kept = at[stay]
        counts = np.diff(np.concatenate([[0], np.cumsum(stay)])[first])
        text = np.searchsorted(first, start, "right") - 1
        upto = np.searchsorted(text, np.arange(len(first)))
        runs = pa.StructArray.from_arrays([pa.array(start - first[text]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
        collapsed = joined(raw, words.start[kept], words.end[kept], counts)
        yield pa.record_batch([*[batch.column(c) for c in carry], pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), runs), pa.array(collapsed, pa.binary())],
                              names=[*carry, "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, carry: list[str], exponent: int = 2, least: int = 2, tail=None) -> DataFrame:
    """The carried columns as ``doc``, n_words, runs (start, length, period of
    every run of ``exponent`` periods and ``least`` words, by start, then
    period) and collapsed (the words without those that a run repeats, joined
    by one space, UTF-8).  ``tail(doc_id, n)`` may give (a, p): the text's words
    from a on are first made periodic with period p."""
    id_ = [F.col("doc_id").cast("long").alias("tail_key")] if tail is not None else []
    step = docs.select(F.struct(*named(carry)).alias("doc"), F.col("text"), *id_)
    schema = f"doc {step.schema['doc'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed binary"
    return step.mapInArrow(functools.partial(_runs_of, exponent=exponent, least=least, tail=tail, carry=["doc"]), schema)


def digest(lines: list[str]) -> str:
    return hashlib.sha256("".join(lines).encode()).hexdigest()

"""Language identification by language-bitmask n-gram filters.

Training counts the byte trigrams (letters lower-cased, everything else one
blank) of all labelled texts per language.  A language keeps a trigram whose
rate is at least ``RATE`` (so at most 1 / RATE of them) and at least a quarter
of the best language's rate.  The filter is a Bloom filter sliced by language:
each of its positions holds a bitmask of languages, so one probe of a trigram
(the AND of its positions) gives every language that holds it.

A text's trigrams are probed once each; the per-language popcounts are corrected
for the language's false-positive rate (measured from its filled positions) and
the largest share decides.

Null text, or one without a letter: ``und``, score 0.  No labelled text: every
text is ``und``.  Equal shares: the first name.  Only text and language are
ever read.  Bitmasks have as many 64-bit words as the languages need, so any
number of labels works (8 MB of filter per 64); a label with little text keeps
all its trigrams above the rate.  Very long texts are read whole, in pieces of
rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import in_slices, named
from corpuskit.llm.encoding import utf8
from corpuskit.session import materialize

RATE, SHARE = 1e-5, 0.25
SLOTS, PROBES = 1 << 20, 3  # positions of the filter (8 MB per word of a bitmask) and positions per trigram


def _alphabet() -> np.ndarray:
    """Byte to symbol: 0 blank, 1-26 letters, 27.. bytes of other scripts."""
    lut = np.zeros(256, np.int64)
    for c in range(26):
        lut[0x61 + c] = lut[0x41 + c] = c + 1
    lut[0x80:] = np.arange(27, 27 + 128)
    return lut


ALPHABET, SYMBOLS = _alphabet(), 155


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, text) of every trigram that has a letter in its middle."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = ALPHABET[raw]
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (s[1:-1] > 0) & (text[:-2] == text[2:])
    return code[keep], text[:-2][keep]


def _count(batches):
    for batch in in_slices(batches, "text"):
        raw, off = utf8(batch.column("text"))
        code, text = trigrams(raw, off)
        names, of = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        wide = SYMBOLS ** 3
        both, n = np.unique(of[text] * wide + code, return_counts=True)
        yield pa.record_batch([pa.array(names[both // wide], pa.string()), pa.array(both % wide), pa.array(n)], names=["lang", "code", "n"])


def _positions(code: np.ndarray) -> list[np.ndarray]:
    from corpuskit.llm.textwords import mix

    h = mix(code.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(20 * p)) & np.uint64(SLOTS - 1)).astype(np.int64) for p in range(PROBES)]


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, filter, false-positive rates) from columns text, lang.

    All texts are counted; what reaches the driver is at most 1 / RATE
    trigrams of each language, language by language."""
    texts = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = texts.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "trigrams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(total, "lang").select("lang", "code", (F.col("n") / F.col("total")).alias("rate"), "n")
    best = F.max("rate").over(Window.partitionBy("code"))  # at most one row per language
    kept = rated.withColumn("best", best).where((F.col("rate") >= RATE) & (F.col("rate") >= SHARE * F.col("best"))).select("lang", "code")
    names = sorted(r["lang"] for r in total.select("lang").collect())
    table, fill = np.zeros((max(1, -(-len(names) // 64)), SLOTS), np.uint64), np.zeros(len(names))
    rows = kept.toArrow()
    place = {name: k for k, name in enumerate(names)}
    of, codes = np.fromiter((place[x] for x in rows["lang"].to_pylist()), np.int64, len(rows)), rows["code"].to_numpy()
    order = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[order], np.arange(len(names) + 1))
    for k in range(len(names)):
        word, bit = table[k // 64], np.uint64(k % 64)
        for at in _positions(codes[order[edge[k]:edge[k + 1]]]):
            word[at] |= np.uint64(1) << bit
        fill[k] = ((word >> bit) & np.uint64(1)).mean() ** PROBES
    return names, table, fill


def _predict(batches, names: list[str], shared):
    table, fill = shared.value
    for batch in in_slices(batches, "text"):
        raw, off = utf8(batch.column("text"))
        code, text = trigrams(raw, off)
        places = _positions(code)
        masks = [functools.reduce(np.bitwise_and, (word[at] for at in places)) for word in table]
        n = np.bincount(text, minlength=batch.num_rows)
        share = np.zeros((batch.num_rows, max(len(names), 1)))
        for bit in range(len(names)):
            hits = np.bincount(text, weights=((masks[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.float64), minlength=batch.num_rows)
            share[:, bit] = np.clip((hits - n * fill[bit]) / np.maximum(n * (1 - fill[bit]), 1e-9), 0, 1)
        has_letter = _has_letter(batch.column("text"), raw, off)
        known = has_letter & bool(names)
        best = share.argmax(axis=1)
        lang = [names[b] if k else "und" for b, k in zip(best, known)]
        score = np.where(known, share[np.arange(len(best)), best], 0.0)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(lang, pa.string()), pa.array(score)], names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"])


def _has_letter(column: pa.Array, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """An ASCII letter, or else (looked up one by one) any other letter."""
    upto = np.concatenate([[0], np.cumsum((ALPHABET[raw] > 0) & (raw < 0x80))])
    found = upto[off[1:]] > upto[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(map(str.isalpha, column[int(i)].as_py() or ""))
    return found


def identify(docs: DataFrame, carry: list[str], model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """The carried columns with lang_pred and score (0 to 1)."""
    names, table, fill = model
    shared = docs.sparkSession.sparkContext.broadcast((table, fill))
    picked = docs.select(*named(carry), F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "text")
    return picked.mapInArrow(functools.partial(_predict, names=names, shared=shared), f"{schema}, lang_pred string, score double")

"""Lists of strings inside one large JSON document, read by splits.

A document ``["...", ...]`` or ``{"responses": ["...", ...], ...}`` is a single
JSON value, which Spark's reader gives to one task.  Here the file is read as
the pieces between its quote characters, in any number of byte ranges:

1. a quote is escaped if its piece ends with an odd number of backslashes, which
   needs no context; counting the others per split, with running sums over the
   splits of a document (one small row each), tells for every piece whether it
   lies inside a string;
2. the bare words outside of strings (null, true, numbers) are counted the same
   way, so every string and word has its number in the document;
3. for a list under a key, brackets outside of strings are summed too, which
   tells the top-level keys (a few rows) and so the values between the list's
   key and the next one;
4. the pieces of every string are joined and unescaped; only strings that cross
   a split's edge are shuffled.

List elements must be strings, null, numbers or booleans (as their text), not
lists or objects.  A document is a file, and ``idx`` counts within each; with
``parts`` it is all files of a folder in the order of their names, each of them
whole lines that end outside of strings.  A bad UTF-8 byte becomes U+FFFD.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_order(path: str) -> list[Column]:
    """The order of written parts: the path up to the first digit of the file's
    name, that number (``part-100000`` follows ``part-99999``), the name."""
    number = F.expr(f"try_cast(regexp_extract({path}, '/[^/0-9]*([0-9]+)[^/]*$', 1) as decimal(38, 0))")
    return [F.regexp_extract(path, "^(.*/[^/0-9]*)", 1), F.coalesce(number, F.lit(-1).cast("decimal(38,0)")), F.col(path)]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    pieces = spark.read.option("lineSep", '"').text(path)
    return pieces.select(F.xxhash64(file).alias("file"), block.alias("block"), F.make_valid_utf8("value").alias("value"), file.alias("path"))


def _closes(value: Column) -> Column:
    """Whether the quote after a piece is none that a backslash escapes."""
    return F.length(F.regexp_extract(value, r"(\\*)$", 1)) % 2 == 0


def _quotes(pieces: DataFrame, parts: bool) -> dict[tuple, tuple]:
    """{(file, block): (quotes,)} in the order of the splits, one small row each."""
    counted = pieces.groupBy("path", "file", "block").agg(F.count_if(_closes(F.col("value"))).alias("quotes"))
    if parts:  # no quote follows the last piece of a part
        last = F.col("block") == F.max("block").over(Window.partitionBy("file"))
        counted = counted.withColumn("quotes", F.col("quotes") - last.cast("int"))
    return {(r["file"], r["block"]): (r["quotes"],) for r in counted.orderBy(*file_order("path"), "block").collect()}


def _before(totals: dict[tuple, tuple], parts: bool) -> dict[tuple, tuple]:
    """The sums over the splits of the document before each split."""
    out, now, sums = {}, None, ()
    for (file, block), more in totals.items():
        if now is None or (file != now and not parts):
            sums = (0,) * len(more)
        now = file
        out[file, block] = sums
        sums = tuple(x + y for x, y in zip(sums, more))
    return out


def _real(values: pa.Array) -> np.ndarray:
    out = np.ones(len(values), bool)
    for i in np.flatnonzero(pc.ends_with(values, "\\").to_numpy(zero_copy_only=False)):
        text = values[int(i)].as_py()
        out[i] = (len(text) - len(text.rstrip("\\"))) % 2 == 0
    return out


def _parts(batches: Iterator[pa.RecordBatch], known) -> Iterator[tuple]:
    """(file, block, values, quotes before each piece, real) of runs of pieces of one split."""
    now, quotes = None, 0
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(file)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi == lo:
                continue
            key = (int(file[lo]), int(block[lo]))
            if key != now:
                now, quotes = key, known.value[key][0]
            values = batch.column("value").slice(lo, hi - lo)
            real = _real(values)
            before = quotes + np.cumsum(real) - real
            quotes += int(real.sum())
            yield *key, values, before, real


_DEPTHS = (("[", 1), ("{", 1), ("]", -1), ("}", -1))
_BARE = r"[^\s,:\[\]{}\x{feff}]+"
_WORDS = re.compile(r"[^\s,:\[\]{}\ufeff]+", re.ASCII)


def _changes(batches, known):
    """Sum of the brackets and count of the bare words outside of strings, per
    run of pieces."""
    for file, block, values, before, _ in _parts(batches, known):
        outside = values.filter(pa.array(before % 2 == 0))
        change = sum(sign * int(pc.sum(pc.count_substring(outside, mark)).as_py() or 0) for mark, sign in _DEPTHS)
        bare = int(pc.sum(pc.count_substring_regex(outside, _BARE)).as_py() or 0)
        yield pa.record_batch([pa.array([file]), pa.array([block]), pa.array([change]), pa.array([bare])], names=["file", "block", "change", "bare"])


def _keys(batches, known):
    """Of the strings at depth 1: their pieces (kind 0) with the number of the
    string, and whether a colon follows (kind 1), told by the number of the
    quote that opens them."""
    now, depth, bare = None, 0, 0
    for file, block, values, before, _ in _parts(batches, known):
        if (file, block) != now:
            now = (file, block)
            _, depth, bare = known.value[now]
        quotes, kinds, numbers, texts = [], [], [], []
        for text, q in zip(values.to_pylist(), before.tolist()):
            if q % 2:
                if depth == 1:
                    quotes, kinds, numbers, texts = [*quotes, q], [*kinds, 0], [*numbers, (q - 1) // 2 + bare], [*texts, text]
                continue
            if depth == 1 and q and text.lstrip().startswith(":"):
                quotes, kinds, numbers, texts = [*quotes, q - 1], [*kinds, 1], [*numbers, None], [*texts, ""]
            if text != ",":
                depth += sum(sign * text.count(mark) for mark, sign in _DEPTHS)
                bare += len(_WORDS.findall(text))
        if quotes:
            yield pa.record_batch([pa.array([file] * len(quotes)), pa.array(quotes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["file", "quote", "kind", "nr", "text"])


def _strings(batches, known, crossing: bool):
    """Strings whole within a split and bare words, or the parts of strings that
    cross an edge: (file, nr, block, text)."""
    held: list[str] = []
    now, nr, began, bare = None, None, True, 0

    def row(files, numbers, blocks, texts):
        return pa.record_batch([pa.array(files, pa.int64()), pa.array(numbers, pa.int64()), pa.array(blocks, pa.int64()), pa.array(texts, pa.string())], names=["file", "nr", "block", "text"])

    for file, block, values, before, real in _parts(batches, known):
        if (file, block) != now:
            if held and crossing:
                yield row([now[0]], [nr], [now[1]], ['"'.join(held)])
            now, held, began = (file, block), [], not (before[0] % 2)
            bare = known.value[now][2]
        numbers, texts = [], []
        inside, outside = np.flatnonzero(before % 2), np.flatnonzero(before % 2 == 0)
        words = np.zeros(len(values), np.int64)
        words[outside] = pc.count_substring_regex(values.take(pa.array(outside)), _BARE).to_numpy(zero_copy_only=False)
        bares = bare + np.cumsum(words) - words
        bare += int(words.sum())
        for text, q, n, closes in zip(values.take(pa.array(inside)).to_pylist(), before[inside].tolist(), bares[inside].tolist(), real[inside].tolist()):
            nr = (q - 1) // 2 + n
            held.append(text)
            if closes:
                if began != crossing:
                    numbers.append(nr)
                    texts.append('"'.join(held))
                held, began = [], True
        for i in [] if crossing else np.flatnonzero(words).tolist():
            for j, word in enumerate(_WORDS.findall(values[i].as_py())):
                numbers.append(int(before[i]) // 2 + int(bares[i]) + j)
                texts.append(None if word == "null" else word)
        if numbers:
            yield row([file] * len(numbers), numbers, [block] * len(numbers), texts)
    if held and crossing:
        yield row([now[0]], [nr], [now[1]], ['"'.join(held)])


@F.pandas_udf(T.StringType())
def _unescaped(raw):
    return raw.map(lambda x: json.loads(f'"{x}"', strict=False) if "\\" in x else x, na_action="ignore")


def read_strings(spark: SparkSession, path: str, key: str | None, parts: bool = False) -> DataFrame:
    """(idx, text): the values of the document's list (``key`` None), or of the
    list under a top-level ``key``."""
    pieces = _pieces(spark, path)
    quotes = _quotes(pieces, parts)
    pieces = pieces.drop("path")
    counted = spark.sparkContext.broadcast(_before(quotes, parts))
    changes = pieces.mapInArrow(functools.partial(_changes, known=counted), "file long, block long, change long, bare long")
    changes = changes.groupBy("file", "block").agg(F.sum("change").alias("change"), F.sum("bare").alias("bare"))
    more = {(r["file"], r["block"]): (r["change"], r["bare"]) for r in changes.collect()}  # one small row per split
    known = spark.sparkContext.broadcast(_before({split: n + more[split] for split, n in quotes.items()}, parts))
    document = (F.lit(0).cast("long") if parts else F.col("file")).alias("file")
    schema = "file long, nr long, block long, text string"
    strings = lambda crossing: pieces.mapInArrow(functools.partial(_strings, known=known, crossing=crossing), schema).select(document, "nr", "block", "text")
    joined = strings(True).groupBy("file", "nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), '"').alias("text"))
    found = strings(False).select("file", "nr", "text").union(joined)
    if key is None:
        return found.select(F.col("nr").alias("idx"), _unescaped("text").alias("text"))
    ends = pieces.mapInArrow(functools.partial(_keys, known=known), "file long, quote long, kind int, nr long, text string").withColumn("file", document)
    # top-level keys: strings at depth 1 with a colon after them
    keys = ends.groupBy("file", "quote").agg(F.max("kind").alias("colon"), F.max("nr").alias("at"), F.max(F.when(F.col("kind") == 0, F.col("text"))).alias("name")).where("colon = 1")
    after = F.lead("at").over(Window.partitionBy("file").orderBy("at"))
    wanted = keys.withColumn("to", F.coalesce(after, F.lit((1 << 62)))).where(F.col("name") == key).select("file", "at", "to")
    if wanted.isEmpty():
        raise ValueError(f"{path} has no {key!r} list")
    held = found.join(F.broadcast(wanted), "file").where((F.col("nr") > F.col("at")) & (F.col("nr") < F.col("to")))
    return held.select((F.col("nr") - F.col("at") - 1).alias("idx"), _unescaped("text").alias("text"))

"""Line dedup by winnowing over line hashes (DataFrame expressions only).

A repeated run is a sequence of whole consecutive lines of at least 50 words or
8 lines that also stands at an earlier place (by doc_id, then text, then line).
Its lines are deleted at the later places.

1. Windows: from every line forward, and to every line backward, the shortest
   sequence that has 50 words or 8 lines.  Every run is a union of windows.
2. The least line hash of a window is its fingerprint, so equal windows have
   the same one; fingerprints that stand at one place only are done.
3. Places with a repeated fingerprint are extended to their windows in both
   directions and joined by the whole window (128-bit hash); later ones go.

Null text: stays null.  Rows equal in id and text are one document: they get
the same lines.  Null ids come first.  Any extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import named
from corpuskit.session import materialize

MIN_WORDS, MAX_LINES = 50, 8


def _windows(hashes: Column, counts: Column, more: Column, min_words: int, max_lines: int) -> Column:
    """array<struct<at, lines, print, print_at, a, b>> of a text's windows."""
    n = F.size(hashes)

    def lengths(i: Column, sign: int) -> Column:
        # the shortest number of lines with min_words words, or max_lines
        words = F.lit(0)
        length = F.lit(max_lines)
        steps = []
        for k in range(max_lines - 1):
            words = words + F.coalesce(F.get(counts, i + sign * k), F.lit(0))
            steps.append((words >= min_words, k + 1))
        for enough, k in reversed(steps):
            length = F.when(enough, F.lit(k)).otherwise(length)
        return length

    def window(at: Column, length: Column) -> Column:
        part = F.slice(hashes, at + 1, length)
        least = F.array_min(part)
        return F.struct(at.alias("at"), length.alias("lines"), least.alias("print"), (at + F.array_position(part, least).cast("int") - 1).alias("print_at"),
                        F.xxhash64(part).alias("a"), F.xxhash64(length, F.slice(more, at + 1, length)).alias("b"))

    each = F.sequence(F.lit(0), n - 1)
    ahead = F.transform(each, lambda i: F.struct(i.alias("at"), lengths(i, 1).alias("n")))
    back = F.transform(each, lambda i: F.struct((i - lengths(i, -1) + 1).alias("at"), lengths(i, -1).alias("n")))
    inside = F.filter(F.array_union(ahead, back), lambda w: (w["at"] >= 0) & (w["at"] + w["n"] <= n))
    return F.transform(inside, lambda w: window(w["at"], w["n"]))


def _lines(docs: DataFrame) -> DataFrame:
    """Line hashes (two of 64 bits) and word counts of every distinct document."""
    lines = F.split("text", "\n")
    step = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), lines.alias("_l"))
    return step.select("doc_id", "text_key", F.transform("_l", lambda x: F.xxhash64(x)).alias("h"), F.transform("_l", lambda x: F.xxhash64(F.lit(1), x)).alias("m"),
                       F.transform("_l", lambda x: F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))).alias("c"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """(doc_id, text_key, gone): the numbers of the lines to delete."""
    lined = _lines(docs).select("doc_id", "text_key", _windows(F.col("h"), F.col("c"), F.col("m"), min_words, max_lines).alias("w"))
    windows = materialize(lined, "line-windows")
    marks = windows.select("doc_id", "text_key", F.explode(F.array_distinct(F.transform("w", lambda x: F.struct(x["print"].alias("print"), x["print_at"].alias("print_at"))))).alias("p"))
    often = marks.groupBy(F.col("p.print").alias("print")).agg(F.count("*").alias("n")).where("n > 1").select("print")
    places = windows.select("doc_id", "text_key", F.explode("w").alias("w")).select("doc_id", "text_key", "w.*").join(often, "print", "left_semi")
    places = materialize(places, "line-places")
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "text_key", "at")
    first = places.groupBy("a", "b", "lines").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = places.join(first, ["a", "b", "lines"]).where(place > F.col("first"))
    spread = later.select("doc_id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lines") - 1)).alias("line")).distinct()
    return spread.groupBy("doc_id", "text_key").agg(F.collect_list("line").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """All columns of ``docs`` with the text without its later repeats, and
    ``lines_seen`` and ``lines_gone``."""
    gone = repeated_lines(docs, min_words, max_lines).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    # the columns travel in one struct, so their names meet no other
    whole = docs.select(F.struct(*named(docs.columns)).alias("doc"))
    text = F.col("doc.text")
    joined = whole.join(gone, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("key")), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.element_at(F.transform(F.array(lines), lambda arr: F.array_join(F.transform(left, lambda i: F.get(arr, i)), "\n")), 1)
    kept = F.when(F.col("gone").isNull(), text).otherwise(rest)
    return joined.select(*[(kept if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns],
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines_seen"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("lines_gone"))

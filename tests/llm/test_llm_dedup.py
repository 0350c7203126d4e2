"""Near-duplicates, exact substrings, repeated lines, decontamination."""

import collections
import hashlib

import llm_cases as C
import numpy as np
import pytest

from corpuskit.llm import neardup, substrings
from corpuskit.llm.components import components
from corpuskit.llm.decontaminate import decontaminate
from corpuskit.llm.linededup import dedup_lines
from corpuskit.llm.neardup import near_duplicates
from corpuskit.llm.substrings import remove_repeats, repeated_columns


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates_match_brute_force(spark):
    docs = C.table(spark)
    source = pairs(docs)
    want = {source[i][0]: min(source[j][0] for j in g) for g in C.near_groups(source) for i in g}
    got = near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) == r["first"] for r in got)
    text = dict(source)
    assert all(r["n_shingles"] == len(C.shingles(text[r["doc_id"]])) for r in got)


def test_near_duplicates_null_ids_and_repeats(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    source = pairs(docs)
    got = near_duplicates(docs).collect()
    assert len(got) == len(source)
    groups = C.near_groups(source)
    # one first row in every group; textless rows are groups of their own
    assert sum(r["first"] for r in got) == len(groups)
    ids = collections.Counter((r["doc_id"], r["component_id"]) for r in got)
    want = collections.Counter()
    for g in groups:
        named = [source[i][0] for i in g if source[i][0] is not None]
        for i in g:
            want[source[i][0], min(named) if named else None] += 1
    assert ids == want


def test_links_across_components_of_one_bucket(spark, monkeypatch):
    """A chain a-b-c-d of neighbours at the threshold, with blocks of two rows."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    words = [f"w{i}" for i in range(130)]
    data = [(i, " ".join(words[6 * i:6 * i + 60])) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    want = {data[i][0]: min(data[j][0] for j in g) for g in C.near_groups(data) for i in g}
    assert got == want and len(set(want.values())) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (3, 4), (7, 7), (20, 21), (21, 22), (22, 20), (4, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {n: r for n, r in got.items() if n != r} == {2: 1, 3: 1, 4: 1, 30: 1, 10: 9, 21: 20, 22: 20}
    path = [(i, i + 1) for i in range(64)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 65))


@pytest.mark.parametrize("hot", [50_000, 1])
def test_substrings_match_brute_force(spark, hot):
    docs = C.table(spark, null_ids=True, repeats=True)
    source = pairs(docs)
    want = collections.Counter((i, *x) for (i, _), x in zip(source, C.cut_repeats([t for _, t in source])))
    got = remove_repeats(docs, hot=hot).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == want


def test_substrings_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 512)
    docs = C.table(spark, seed=11)
    source = pairs(docs)
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()}
    assert got == {i: x[1] for (i, _), x in zip(source, C.cut_repeats([t for _, t in source]))}


def test_columns_mark_aligned_repeats(tmp_path):
    rng = np.random.default_rng(3)
    n, length = 60, 12
    left = rng.integers(0, 8, n)
    size = length + rng.integers(0, left + 1)  # a string starts at or before its anchor
    pieces = np.zeros((n, 24), np.uint8)
    for i in range(n):
        pieces[i, :size[i]] = rng.integers(65, 67, size[i])
        if i % 3:
            pieces[i, :size[i]] = 66  # long runs
    got = repeated_columns(pieces, left.astype(np.int64), size.astype(np.int64), length, str(tmp_path))
    strings = collections.Counter((left[i] - s, pieces[i, s:s + length].tobytes()) for i in range(n) for s in range(size[i] - length + 1))
    for i in range(n):
        for s in range(size[i] - length + 1):
            assert got[i, s] == (strings[left[i] - s, pieces[i, s:s + length].tobytes()] > 1)


@pytest.mark.parametrize("min_words,max_lines", [(50, 8), (6, 3)])
def test_lines_match_brute_force(spark, min_words, max_lines):
    docs = C.table(spark)
    source = sorted(pairs(docs))
    want = {}
    for (i, t), gone in zip(source, C.deduped_lines(source, min_words, max_lines)):
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    got = dedup_lines(docs, min_words, max_lines)
    assert got.columns == [*docs.columns, "lines_seen", "lines_gone"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_lines_of_equal_rows_and_null_ids(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    got = dedup_lines(docs).select("doc_id", "text", "lines_gone").collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["lines_gone"])
    repeated = C.rows()[20][0]
    assert len(by[repeated]) == 1  # equal rows keep equal lines


def items(spark):
    words = C.alnum_words(C.texts()[19])
    return [(1, " ".join(words[5:30])), (2, "Walking, HOUSE"), (3, " ".join(words[100:113]) + " other end"), (4, None), (5, "..."), (None, "seven thought"), (2, " ".join(words[40:49])), (10, "É")]


def test_decontamination_matches_brute_force(spark):
    bench = items(spark)
    docs = C.table(spark, null_ids=True, repeats=True)
    source = pairs(docs)
    named = [("null" if i is None else i, t) for i, t in bench]
    want = collections.Counter((i, *(str(x) for x in C.contamination(t, named))) for i, t in source)
    got = decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(list(r["items"])), str(r["contaminated"])) for r in got) == want


def test_empty_tables(spark):
    none = C.empty(spark)
    assert near_duplicates(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert dedup_lines(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(C.table(spark), bench).collect())

"""Periodic runs, repeated passages and the conversation trie."""

import collections
import hashlib
import math
import random
import zlib

import llm_cases as C
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import blockanchors, convtrie, periodic
from corpuskit.llm.blockanchors import remove_passages
from corpuskit.llm.convtrie import contract, numbered, hashed_turns, prefix_trie, rebuilt
from corpuskit.llm.periodic import catch_runs, find_runs, periodic_tail


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def brute_runs(words, exponent, least):
    """(start, end, period) of maximal stretches, the least period of each."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences():
    rng = random.Random(5)
    yield from ["", "a", "aa", "ab", "a" * 300, "ab" * 120 + "b", "abc" * 50 + "x" + "abc" * 50, fibonacci(377), "".join("ab"[bin(i).count("1") % 2] for i in range(1024))]
    for k in (2, 3, 5):
        for n in (7, 40, 150, 500):
            yield "".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    base = "".join(rng.choice("abcdefghijkl") for _ in range(97))
    yield base * 5 + base[:13] + "z" + (base[:31] * 9)[:200] + base * 2


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 2), (4, 6), (5, 30)])
def test_runs_match_brute_force_over_texts_of_one_batch(exponent, least):
    texts = list(sequences())
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.array([ord(c) for t in texts for c in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = list(zip(*(x.tolist() for x in catch_runs(words, first, exponent, least))))
    want = []
    for at, t in zip(first.tolist(), texts):
        want += [(at + s, at + e, q) for s, e, q in brute_runs(t, exponent, least)]
    assert got == want and len(want) > 5


def test_runs_do_not_depend_on_the_cells_looked_at(monkeypatch):
    texts = list(sequences())
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.array([ord(c) for t in texts for c in t], np.uint64)
    whole = [x.tolist() for x in catch_runs(words, first)]
    monkeypatch.setattr(periodic, "CELLS", 64)
    assert [x.tolist() for x in catch_runs(words, first)] == whole


def told_runs(doc_id, text, tail):
    w = C.white_words(text)
    told = tail(doc_id, len(w)) if tail else None
    if told:
        a, p = told
        w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w, 4, 6)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return len(w), [(s, e - s, q) for s, e, q in runs], " ".join(x for i, x in enumerate(w) if i not in gone).encode()


@pytest.mark.parametrize("tail", [None, periodic_tail])
def test_find_runs_odd_rows(spark, tail):
    docs = C.table(spark, null_ids=True, repeats=True)
    docs = docs.where(F.length("text").isNull() | (F.length("text") < 8_000))  # the brute force is quadratic
    got = find_runs(docs, docs.columns, 4, 6, tail).collect()
    want = collections.Counter(repr((r["doc_id"], *told_runs(r["doc_id"], r["text"], tail))) for r in docs.collect())
    assert collections.Counter(repr((r["doc"]["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]))) for r in got) == want
    assert any(r["runs"] for r in got)
    assert find_runs(C.empty(spark), ["doc_id"]).count() == 0


def test_periodic_tail_is_one_in_ten():
    told = {i: periodic_tail(i, 100) for i in range(1000)}
    assert {i for i, x in told.items() if x} == {i for i in told if zlib.crc32(b"%d" % i) % 10 == 0}
    assert periodic_tail(None, 100) is None and periodic_tail(next(i for i, x in told.items() if x), 0) is None
    assert all(0 <= a < 100 and 1 <= p <= 34 for a, p in filter(None, told.values()))


def brute_passages(docs, length=13):
    least: dict[tuple, int] = {}
    split = [(i, C.white_words(t)) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - length + 1 if i is not None else 0):
            k = tuple(w[s:s + length])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in split:
        gone = {s + d for s in range(len(w) - length + 1 if i is not None else 0) if least[tuple(w[s:s + length])] < i for d in range(length)}
        spans = [(p, next(q for q in range(p, len(w) + 1) if q not in gone)) for p in sorted(gone) if p - 1 not in gone]
        out.append((i, len(w), len(gone), spans, " ".join(x for p, x in enumerate(w) if p not in gone).encode()))
    return out


def same_passages(df, docs, **kw):
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], [tuple(x) for x in r["spans"]], bytes(r["kept"]))) for r in remove_passages(df, **kw).collect())
    want = sorted(map(repr, brute_passages(docs)))
    assert got == want
    return want


@pytest.mark.parametrize("bits", [1 << 18, 1 << 22])  # the small bitmap is nearly full: chance hits decide nothing
def test_passages_match_brute_force(spark, bits):
    docs = C.table(spark, null_ids=True, repeats=True)
    same_passages(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], bits=bits)


def test_passages_at_any_alignment_and_in_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared, long = prose(13), prose(60)
    docs = []
    for i in range(40):
        lead = prose(rng.randrange(0, 30))
        docs.append((100 - i, " ".join(lead + (shared if i % 2 else shared[:12]) + prose(rng.randrange(0, 9)))))
        docs.append((200 + i, " ".join(prose(i) + long[:20 + i] + prose(3))))
    copy = " ".join(prose(50))
    docs += [(300 + i, copy) for i in range(30)] + [(7, copy), (7, copy), (8, " ".join(["a"] * 40)), (9, " ".join(["a"] * 14)), (None, copy)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = same_passages(df, docs)
    assert sum("(0, 50)" in x for x in want) == 30
    assert remove_passages(df.limit(0)).count() == 0
    assert remove_passages(df.where("text is null")).count() == 0


def test_every_window_holds_one_block():
    block = (blockanchors.LENGTH + 1) // 2
    for s in range(50):
        assert sum(s <= i and i + block <= s + blockanchors.LENGTH for i in range(0, 100, block)) == 1


def brute_trie(rows, group=20, most=4):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in convs.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(b"%d" % c) % most
        new[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + v[h:])
    member = collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            member[v[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in member if k)
    out = {}
    for k, m in member.items():
        below = [x for x in member if x[:len(k)] == k]
        saved = sum((len(member[x]) - 1) * len(C.white_words(x[-1][1])) for x in below if x)
        ends = sorted(c for c in m if len(new[c]) == len(k))
        out[len(k), min(m), sha(",".join(map(str, ends)))] = (min(member[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in below), saved)
    return out


def conversations(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), 1000, 1020, -20, -13]:
        opening = rng.randrange(3)
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"turn {t} of opening {opening}" if t < 3 else f"free {rng.randrange(3)}  words\there"))
    rows += [(20, None, None, None), (500, 3, "user", ""), (500, 5, None, "x"), (None, 1, "user", "nobody's")]
    rows += [(540, t, "user", f"long {t}") for t in range(0, 360, 3)]  # a chain over several spans
    rows += [(541, t, "user", f"long {t}") for t in range(0, 300, 3)]
    return rows


def trie_rows(df):
    got = {}
    for r in df.collect():
        key = (r["depth"], r["conv_id"], r["ends_sha256"])
        assert key not in got
        got[key] = (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
    return got


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "END_BLOCK", 16)  # ends of a node over several pieces
    monkeypatch.setattr(convtrie, "SPAN", 32)
    rows = conversations()
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, a int").repartition(4)
    assert trie_rows(prefix_trie(*rebuilt(df))) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert prefix_trie(*rebuilt(empty)).count() == 0
    assert prefix_trie(*rebuilt(spark.createDataFrame([(None, 1, "user", "x")], schema))).count() == 0
    turnless = next(c for c in range(1, 20) if zlib.crc32(b"%d" % c) % 4 >= 1)  # its base is absent
    rows = [(turnless, 0, "user", "gone")]
    assert trie_rows(prefix_trie(*rebuilt(spark.createDataFrame(rows, schema)))) == brute_trie(rows)
    assert brute_trie(rows) == {(0, turnless, sha(str(turnless))): (None, 1, 0, 1, 0)}


def test_equal_turn_numbers_are_turns_of_their_own(spark):
    rows = [(1, 5, "user", t) for t in "abcab"]
    got = numbered(hashed_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted(r["nth"] for r in got) == [1, 2, 3, 4, 5]


def test_contraction_of_a_forest(spark):
    """A star, a long chain, a caterpillar and a single node."""
    parent = {("s", 0): None, ("x", 0): None}
    parent |= {("s", i): ("s", 0) for i in range(1, 200)}
    parent |= {("c", i): ("c", i - 1) if i else None for i in range(90)}
    parent |= {("k", i): ("k", i - 1) if i else None for i in range(40)} | {("l", i): ("k", i) for i in range(40)}
    number = {k: i for i, k in enumerate(parent)}
    rows = [(number[k], 7, *((None, None) if p is None else (number[p], 7)), number[k] % 11) for k, p in parent.items()]
    got = {r["a"]: (r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in contract(spark.createDataFrame(rows, "a long, b long, pa long, pb long, saved long")).collect()}
    kids, total = collections.Counter(p for p in parent.values()), {}
    for k in reversed(sorted(parent, key=lambda k: depth(parent, k))):
        leaves, saved = total.get(k, (0, 0))
        total[k] = (leaves + (not kids[k]), saved + number[k] % 11)
        if parent[k] is not None:
            up = total.get(parent[k], (0, 0))
            total[parent[k]] = (up[0] + total[k][0], up[1] + total[k][1])
    assert got == {number[k]: (kids[k], *total[k]) for k in parent}


def depth(parent, k):
    d = 0
    while parent[k] is not None:
        k, d = parent[k], d + 1
    return d

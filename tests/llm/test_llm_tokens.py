"""Token ids, packing and token files."""

import collections
import itertools
import zlib

import llm_cases as C
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm.encoding import Encoder, load_tokenizer
from corpuskit.llm.packing import pack, plan_bins
from corpuskit.llm.tokenfiles import read_token_files, write_token_files
from corpuskit.session import scratch_path

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, texts):
    return [e.ids for e in load_tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_whole_texts(path):
    texts = C.texts() + ["a,b é,́ x.́y é÷,× a!!b ,, a,.b it's, it',s", " 　x é à  ́a\ńb '' don't I'll 12 345 <|endoftext|> <|startoftext|>x \t\n y", "İstanbul ǅ ﬁ ½ ²", "x\x1cy \x85 z \x85"]
    ids, off = Encoder(path).encode(pa.array(texts))
    for k, want in enumerate(ids_of(path, texts)):
        assert ids[off[k]:off[k + 1]].tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBé ç,.!'’\n\t\u00a0\u3000\u0301123#sté€😀", max_size=40), max_size=4))
def test_pieces_encode_as_whole_texts_property(texts):
    for path in (BYTE, WORD):
        ids, off = Encoder(path).encode(pa.array(texts, pa.string()))
        for k, want in enumerate(ids_of(path, texts)):
            assert ids[off[k]:off[k + 1]].tolist() == want


MARKED = ["see <|endoftext|> here", "a<|endoftext|>b, c|d <|startoftext|>", "<|endoftext|>\nx\n<|endoftext|> y <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof", "text|> z", None, "é<|endoftext|>, é", "<|endoftext|"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_marked_texts_encode_as_the_files_own_tokenizer(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    texts = MARKED + C.texts()
    ids, off = Encoder(path).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == own.encode(t or "", add_special_tokens=False).ids
    assert ids[off[0]:off[1]].tolist() == ([3826, 220, 50256, 994] if path == BYTE else [862, 49407, 763])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "B", " ", "\n", ",", "'s", "é", "|", ">", "1", "\u3000"]), max_size=12).map("".join), max_size=4))
def test_marked_texts_encode_as_whole_texts_property(texts):
    from tokenizers import Tokenizer

    for path in (BYTE, WORD):
        own = Tokenizer.from_file(path)
        ids, off = Encoder(path).encode(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[off[k]:off[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids


def test_cuts_spare_added_tokens_that_bytes_do_not_tell():
    from tokenizers import AddedToken

    enc = Encoder(BYTE)
    assert enc.markers == [b"<|endoftext|>"]
    enc.tok = type(enc.tok).from_file(BYTE)
    enc.tok.add_tokens([AddedToken("b c", lstrip=True)])
    from corpuskit.llm.encoding import markers_of

    enc.markers = markers_of(enc.tok)
    ids, off = enc.encode(pa.array(["a b c d", "", "x, b c"]))
    assert [ids[off[k]:off[k + 1]].tolist() for k in range(3)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in ("a b c d", "", "x, b c")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    plan = plan_bins(counts, 64)
    used = collections.Counter()
    for held, times in plan:
        assert times > 0 and sum(held) <= 64
        for x in held:
            used[x] += times
    assert used == collections.Counter(counts)


def test_replacement_beats_greedy_fill():
    # greedy: 60 + 3; two unpacked pieces fit the expanded gap of 40 more tightly
    plan = plan_bins({60: 1, 35: 1, 22: 1, 18: 1}, 100)
    assert sorted(plan[0][0]) == [18, 22, 60] and plan[0][1] == 1


@pytest.mark.parametrize("kw", [{}, {"null_ids": True, "repeats": True}])
def test_pack(spark, kw):
    docs = C.table(spark, **kw)
    source = docs.select("doc_id", "text").collect()
    got = pack(docs, BYTE, max_tokens=64).collect()
    # places are gapless in every sequence
    for _, held in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in held:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 64
    # the documents come back whole
    made = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got)
    want = collections.Counter()
    for (doc_id, _), ids in zip(source, ids_of(BYTE, [r["text"] for r in source])):
        ids = np.array(ids + [2], "<u4")
        first = len(ids) % 64 or 64
        for piece, lo in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[lo:first] if piece == 0 else ids[lo:lo + 64]
            want[doc_id, piece, lo, len(part), part.tobytes()] += 1
    assert made == want
    assert len({r["sequence_id"] for r in got}) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1


def test_token_files_round_trip(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    source = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in docs.select("doc_id", "text").collect())
    manifest = write_token_files(docs, scratch_path(spark, "files"), WORD)
    got = read_token_files(manifest).orderBy("start").collect()
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [k for k, _ in source]
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    want = collections.Counter((k, zlib.crc32(np.array(ids + [2], "<u4").tobytes())) for (k, _), ids in zip(source, ids_of(WORD, [t for _, t in source])))
    assert collections.Counter(((r["doc_id"] is not None, r["doc_id"] or 0), zlib.crc32(r["ids"])) for r in got) == want


def test_token_files_fetch_only_what_is_asked(spark):
    manifest = write_token_files(C.table(spark), scratch_path(spark, "files"), WORD)
    whole = {r["doc_id"]: r for r in read_token_files(manifest).collect()}
    some = read_token_files(manifest, [5, 62, 10 ** 9]).collect()
    assert {r["doc_id"]: r for r in some} == {k: whole[k] for k in (5, 62)}


def test_damaged_frame_is_noticed(spark):
    manifest = write_token_files(C.table(spark), scratch_path(spark, "files"), WORD)
    name = manifest.orderBy("bytes", ascending=False).first()["file"]
    path = name.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[9] ^= 0xFF
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        read_token_files(manifest).collect()


def test_empty_tables(spark):
    assert pack(C.empty(spark), BYTE).count() == 0
    assert read_token_files(write_token_files(C.empty(spark), scratch_path(spark, "files"), WORD)).count() == 0


def test_forgotten_one_off_pieces_change_no_ids_and_common_ones_are_learned_once(monkeypatch):
    from corpuskit.llm import encoding

    monkeypatch.setattr(encoding, "CACHE_PIECES", 60)
    coder, learned = Encoder(WORD), collections.Counter()
    learn = coder._learn
    coder._learn = lambda pieces: (learned.update(p.strip() for p in pieces), learn(pieces))
    for batch in range(12):
        texts = [f"the common words stay q{batch}x{i} z{i * 977 + batch}" for i in range(20)] + [None, ""]
        ids, off = coder.encode(pa.array(texts))
        assert [ids[lo:hi].tolist() for lo, hi in zip(off, off[1:])] == ids_of(WORD, texts)
        assert len(coder.known) <= 120 and list(coder.known.values()) == list(range(coder.n))
    assert sum(learned.values()) > 240 and learned["common"] == 1

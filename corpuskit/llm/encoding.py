"""Token ids of whole texts, by the ``tokenizers`` library, for Arrow batches.

Both vocabularies split text into words before merging, and an ASCII space
(or line feed) between two non-space characters always ends a word, and so
does a letter before a comma or the like.  So a batch of texts is cut at those places, every distinct piece is encoded once
(with a bounded cache per Python worker), and the ids are gathered back.  The
result equals encoding each whole text; ``tests/llm`` checks this.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

CACHE_PIECES = 600_000  # pieces a worker remembers before it forgets those that did not come again
ENCODE_BYTES = 2 << 20  # text bytes that are encoded at a time
LEARN_PIECES = 5_000  # new pieces that are handed to the library at a time

# Lead bytes of the UTF-8 forms of every non-ASCII white space.
_WIDE_SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_STOPS = np.frombuffer(b"!#$%&*,.:;?|", np.uint8)  # marks that no word or contraction holds


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(path)


def markers_of(tok) -> list[bytes] | None:
    """The strings that the tokenizer takes out of a text before it splits
    words; None if some are not found by their plain bytes alone."""
    added = tok.get_added_tokens_decoder().values()
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
        return None
    return [t.content.encode() for t in added if t.content]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _cuts(raw: np.ndarray, off: np.ndarray, markers: list[bytes] | None) -> np.ndarray:
    """Ascending piece boundaries, all text boundaries included (no other ones
    if the markers cannot be told by their bytes)."""
    n = len(raw)
    if not n:
        return np.zeros(1, np.int64)
    if markers is None:
        return np.unique(off)
    lead = np.isin(raw, np.array(_WIDE_SPACE_LEADS, np.uint8))
    space = raw <= 0x20
    end_ok = ~space                    # a non-space character ends with this byte
    wide_tail = np.zeros(n, bool)
    wide_tail[1:] |= lead[:-1]
    wide_tail[2:] |= lead[:-2]
    end_ok &= ~(wide_tail & (raw >= 0x80))
    start_ok = ~(space | lead)         # a non-space character starts with this byte
    single = np.zeros(n, bool)
    single[1:-1] = end_ok[:-2] & start_ok[2:]
    blank = np.flatnonzero(single & (raw == 0x20))
    feed = np.flatnonzero(single & (raw == 0x0A))
    # a letter (ASCII, or a Latin-1 one other than the two signs) ends before a comma and its like
    lower = raw | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A)
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    mark = np.zeros(n + 1, bool)
    mark[1:-1] = letter[:-1] & np.isin(raw[1:], _STOPS)
    mark[blank] = True
    mark[feed] = True
    mark[feed + 1] = True
    data = raw.tobytes() if markers else b""
    for m in markers:
        at = data.find(m)
        while at >= 0:
            mark[at + 1:at + len(m)] = False
            at = data.find(m, at + 1)
    mark[off] = True
    return np.flatnonzero(mark)


class Encoder:
    """Distinct pieces to ids, kept over the batches of one worker."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.markers = markers_of(self.tok)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)  # pieces met in a later batch than the one that brought them
        self.n = 0

    def _forget(self) -> None:
        """Keep the pieces that came again since the last time, if they are few
        enough; the texts' one-off pieces would fill any cache."""
        keep = np.flatnonzero(self.again[:self.n])
        if len(keep) > CACHE_PIECES // 2:
            return self.reset()
        names = list(self.known)  # in the order of their numbers
        names = [names[k] for k in keep.tolist()]
        first, count = self.off[keep], self.off[keep + 1] - self.off[keep]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(first - (ends - count), count) + np.arange(count.sum())]
        self.reset()
        self._store(names, ids, count)

    def _store(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        base = self.off[self.n]
        while base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(pieces) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[base:base + len(ids)] = ids
        self.off[self.n + 1:self.n + 1 + len(pieces)] = base + np.cumsum(counts)
        for k, p in enumerate(pieces, self.n):
            self.known[p] = k
        self.n += len(pieces)

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), LEARN_PIECES):
            part = pieces[at:at + LEARN_PIECES]
            got = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self._store(part, np.fromiter((i for ids in got for i in ids), np.uint32, int(lens.sum())), lens)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ``ids[offsets[i]:offsets[i + 1]]``."""
        raw, off = utf8(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        cuts = _cuts(raw, off, self.markers)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw))
        coded = pieces.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if self.n > CACHE_PIECES:
            self._forget()
        slot = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new, before = slot < 0, self.n
        self.again[slot[~new]] = True
        self._learn([words[k] for k in np.flatnonzero(new).tolist()])
        slot[new] = np.arange(before, self.n)
        slot = slot[codes]
        first, count = self.off[slot], self.off[slot + 1] - self.off[slot]
        ends = np.cumsum(count)
        total = int(ends[-1])
        # gather: position inside the flat ids of every output id
        at = np.repeat(first - (ends - count), count) + np.arange(total)
        upto = np.concatenate([[0], ends])
        return self.ids[at], upto[np.searchsorted(cuts, off)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)

"""Words as they are spelled (no case folding), for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpuskit.llm.encoding import utf8
from corpuskit.llm.textwords import Words

_WHITE = np.array([0x20, *range(0x09, 0x0E)])
SPELLED = np.arange(256, dtype=np.uint8)
SPELLED[0] = 255  # the byte 0 separates nothing here, and UTF-8 never holds 255
SPELLED[_WHITE] = 0


def spelled_words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """(words, bytes): runs of characters other than the six ASCII white-space
    ones; word i is ``bytes[words.start[i]:words.end[i]]``."""
    return Words(column, SPELLED), utf8(column)[0]


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Texts of ``counts[i]`` words each, one space between; the words are
    ``raw[start:end]``, text after text."""
    size = end - start + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(int(upto[-1])) - np.repeat(upto[:-1] - start, size)
    out = raw[np.minimum(place, len(raw) - 1)] if len(place) else np.zeros(0, np.uint8)
    out[upto[1:] - 1] = 0x20
    data, edge = out.tobytes(), upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b - 1] if b > a else b"" for a, b in zip(edge[:-1], edge[1:])]

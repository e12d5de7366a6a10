"""Words of many texts at once, as numpy arrays: places and 64-bit hashes, computed over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from millrace.llm.packed import GOLDEN, U64, arrow_bytes, hashes, mix, padded

#: Bytes hashed at once; a single longer text is hashed by itself.
CHUNK = 1 << 22


#: Words of letters, digits and all non-ASCII characters; A-Z count as a-z.
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class Words(NamedTuple):
    text: np.ndarray  # number of the text that holds the word, ascending
    start: np.ndarray  # first byte in its text
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_chunk(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        lasts = offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    hash = hashes(padded(LOWERED[data]), start, end - start)
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(text, start - offsets[text], end - offsets[text], hash, np.searchsorted(start, offsets))


def each_text(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, word hashes, starts and ends (in bytes) of each text in turn. A null has no words."""
    data, offsets = arrow_bytes(column)
    for i, j in _chunks(offsets):
        words = _hash_chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            a, b = words.bounds[k], words.bounds[k + 1]
            yield i + k, words.hash[a:b], words.start[a:b], words.end[a:b]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; for fewer words, but not none, one for all of them."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, U64)
    for k in range(size):
        out = mix(out * GOLDEN + hashes[k : n - size + 1 + k])
    return out

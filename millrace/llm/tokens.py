"""Token ids of whole texts with a public byte-level BPE: numpy splits and looks up, the library encodes what is new."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from millrace.llm.packed import Lists, Numbers, padded

END_ID = 0
#: Characters encoded at once (one longer text goes by itself).
CHUNK = 1 << 18
OTHER, LETTER, NUMBER, SPACE = range(4)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Class of each code point, as the library's own pre-tokenizer tells them apart, whichever Unicode it knows.

    It is shown all code points in order: those of a piece are of one class, which the piece's first shows beside ! a and 1.
    """
    from tokenizers import pre_tokenizers

    pieces = lambda text: np.array([at for _, (at, _) in split.pre_tokenize_str(text)], np.int64)
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    at = np.concatenate([np.arange(0x80, 0xD800), np.arange(0xE000, 0x110000)])
    first = pieces("".join(map(chr, at.tolist())))
    begins = np.zeros(9 * len(first), bool)
    begins[pieces("".join(f"!{c}\na{c}\n1{c}\n" for c in map(chr, at[first].tolist())))] = True
    other, letter, number = (~begins[k::9] for k in (1, 4, 7))
    table = np.full(0x110000, OTHER, np.uint8)
    table[at] = np.repeat(np.select([other, letter, number], [OTHER, LETTER, NUMBER], SPACE), np.diff(np.append(first, len(at))))
    for c in range(0x80):
        table[c] = LETTER if chr(c).isalpha() else NUMBER if chr(c).isdigit() else SPACE if chr(c) in " \t\n\x0b\x0c\r" else OTHER
    return table


def piece_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts laid end to end begin; ``firsts`` are the texts' first places.

    The rules are 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces before a space or the end|spaces.
    """
    n = len(points)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start[firsts] = True
    # A run of spaces gives its last one away: a blank joins what follows, any other stands alone.
    after = np.flatnonzero(start[1:] & (kinds[:-1] == SPACE) & (kinds[1:] != SPACE)) + 1
    if len(after):
        after = after[~np.isin(after, firsts, assume_unique=True)]
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
    # A contraction is a piece where its apostrophe begins one.
    quotes = np.flatnonzero((points == 39) & start)
    if len(quotes):
        ends = np.append(firsts, n)[np.searchsorted(firsts, quotes, side="right")]
        one = np.where(quotes + 1 < ends, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 < ends, points[np.minimum(quotes + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for held, size in ((short, 2), (long, 3)):
            at, end = quotes[held], ends[held]
            for k in range(1, size):
                start[at + k] = False
            at = at[at + size < end] + size
            # The blank before a run was given away before; here only the letters after a contraction begin anew.
            start[at[kinds[at] == LETTER]] = True
    return start


def text_pieces(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of texts laid end to end: the padded UTF-8 bytes, where each piece begins, its size, and the pieces before
    each text (one number more than texts)."""
    line = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(line.encode(), np.uint8)
    if not len(line):
        return padded(data), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    start = np.flatnonzero(piece_starts(points, kinds[points], np.unique(bounds[:-1][sizes > 0])))
    before = np.searchsorted(start, bounds)
    if len(data) > len(points):  # places of code points become places of bytes
        start = np.flatnonzero((data & 0xC0) != 0x80)[start]
    return padded(data), start, np.append(start[1:], len(data)) - start, before


class Encoder:
    """Encodes batches of texts with the library. Pre-tokens are encoded apart from each other, so a text's ids are theirs in
    order; a worker encodes each distinct one once. Pieces are known by their bytes, never by a hash alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model.no_truncation()
        self.kinds = _classes()
        self.clear()

    def clear(self) -> None:
        self.numbers, self.ids = Numbers(), Lists()

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces of a blank and letters are encoded as one text, which splits before each blank; others one by one."""
        strings = [p.decode() for p in pieces]
        joined = np.array([s[0] == " " and s[1:].isalpha() for s in strings], bool)
        got = self.model.encode("".join(s for s, j in zip(strings, joined, strict=True) if j), add_special_tokens=False)
        apart = [e.ids for e in self.model.encode_batch_fast([s for s, j in zip(strings, joined, strict=True) if not j], add_special_tokens=False)]
        lists = Lists()
        lists.extend(np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=int(joined.sum())))
        lists.extend(np.fromiter(chain(*apart), np.uint32), np.array([len(x) for x in apart], np.int64))
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])] = np.arange(len(pieces))
        ids, upto = lists.gather(order)
        self.ids.extend(ids, np.diff(upto))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end id, as unsigned 32-bit numbers."""
        end = np.array([END_ID], np.uint32)
        if self.numbers.full:
            self.clear()
        pad, start, size, before = text_pieces(texts, self.kinds)
        ids, upto = self.ids.gather(self.numbers.number(pad, start, size, self._learn))
        cuts = upto[before]
        return [np.append(ids[a:b], end) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: what one task learnt serves the next."""
    return Encoder(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch, in slices of about CHUNK characters, with the ids of its column ``text``. A null is an empty text."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= CHUNK:
                size += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), encoder(path).encode(texts[i:j])
            i = j

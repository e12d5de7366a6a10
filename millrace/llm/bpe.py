"""Byte-level BPE from a file of ranks: distinct pieces are merged together in padded matrices, and ids are turned back into bytes."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only, small_batches
from millrace.llm.packed import U64, Lists, Numbers, Slots
from millrace.llm.tokens import CHUNK, _classes, text_pieces, vocabulary_path

RANKS = "byte_bpe_50k.tiktoken"
NONE = np.int64(1 << 40)
#: Bytes of a piece up to which it is merged in a matrix. There a merge costs its row's width, so longer ones take a heap.
WIDEST = 512
#: Symbols of a matrix; longer lists of pieces are merged in parts.
CELLS = 1 << 20


class Merges:
    """The ranks of a vocabulary, which are its ids, and which two ids make which third."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        if len(set(self.ranks.values())) < len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks a byte, or gives a rank twice")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # Two ids merge if their bytes together are a token, whatever merges made them; so each cut of a token is a pair.
        cuts = [(self.ranks.get(t[:k]), self.ranks.get(t[k:]), rank) for t, rank in self.ranks.items() for k in range(1, len(t))]
        left, right, self.made = np.array([c for c in cuts if c[0] is not None and c[1] is not None], np.int64).reshape(-1, 3).T.copy()
        self.pairs = Slots(max(4, int(len(left)).bit_length() + 1))
        self.pairs.add(*self._key(left, right), np.arange(len(left), dtype=np.int32))
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        self.bytes = Lists()
        lengths = np.zeros(by_id[-1][1] + 1, np.int64)
        lengths[[rank for _, rank in by_id]] = [len(t) for t, _ in by_id]
        self.bytes.extend(np.frombuffer(b"".join(t for t, _ in by_id), np.uint8), lengths)
        self.known = lengths > 0

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (left.astype(U64) << U64(32)) | right.astype(U64), np.ones(len(left), U64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge. An id below 0 stands for no symbol."""
        out = np.full(len(left), NONE)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        found = self.pairs.find(*self._key(left[real], right[real]))
        out[real[found >= 0]] = self.made[found[found >= 0]]
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. A piece that is a token is its id. Others are dealt into matrices by length."""
        out: list[np.ndarray | None] = [np.array([self.ranks[p]], np.uint32) if p in self.ranks else None for p in pieces]
        left = sorted((i for i, ids in enumerate(out) if ids is None), key=lambda i: len(pieces[i]))
        while left:
            if len(pieces[left[-1]]) > WIDEST:
                i = left.pop()
                out[i] = self._merge_long(pieces[i])
                continue
            # The longest ones left and those more than half as long, as many as a matrix holds.
            width = len(pieces[left[-1]])
            n = 1
            while n < min(len(left), CELLS // width) and 2 * len(pieces[left[-1 - n]]) > width:
                n += 1
            rows, left = left[-n:], left[:-n]
            for i, ids in zip(rows, self._merge_rows([pieces[i] for i in rows], width), strict=True):
                out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Each round merges in every row its leftmost pair of least rank; rows without one leave the matrix."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), np.int64(-1))
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for r, line, n in zip(row[done].tolist(), ids[done], sizes[done].tolist(), strict=True):
                    out[r] = line[:n].astype(np.uint32)
                row, ids, ranks, sizes, at, best = row[~done], ids[~done], ranks[~done], sizes[~done], at[~done], best[~done]
                if not len(row):
                    break
            # Every row loses the symbol behind its pair: what follows moves up, and the last column falls away.
            n, wide = np.arange(len(row)), int(sizes.max()) - 1
            columns = np.arange(wide)
            ids[n, at] = best
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            sizes = sizes - 1
            if wide == 1:
                ranks = np.full((len(row), 1), NONE)
                continue
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns > at[:, None]), axis=1)
            for shift in (-1, 0):  # the pairs that the new symbol closes and opens
                place = at + shift
                real = np.flatnonzero((place >= 0) & (place < wide - 1))
                ranks[real, place[real]] = self.rank(ids[real, place[real]], ids[real, place[real] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same order of merges from a heap of (rank, place): a piece of n bytes takes n log n steps."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < NONE]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.tolist()
        pair: dict[tuple[int, int], int] = {}

        def look(i: int) -> None:
            j = after[i]
            if j >= n:
                rank_at[i] = NONE
                return
            key = (ids[i], ids[j])
            if key not in pair:
                pair[key] = int(self.rank(np.array(key[:1]), np.array(key[1:]))[0])
            rank_at[i] = pair[key]
            if pair[key] < NONE:
                heapq.heappush(heap, (pair[key], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank_at[i] != r:
                continue  # its symbol has gone, or has another pair by now
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in ids if x >= 0], np.uint32)


class RankEncoder:
    """Encodes batches of texts; a worker merges each distinct piece once and knows it by its bytes."""

    def __init__(self, path: str):
        self.merges, self.kinds = Merges(path), _classes()
        self.clear()

    def clear(self) -> None:
        self.numbers, self.ids = Numbers(), Lists()

    def _learn(self, pieces: list[bytes]) -> None:
        lists = self.merges.merge(pieces)
        self.ids.extend(np.concatenate(lists), np.array([len(x) for x in lists], np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        if self.numbers.full:
            self.clear()
        pad, start, size, before = text_pieces(texts, self.kinds)
        ids, upto = self.ids.gather(self.numbers.number(pad, start, size, self._learn))
        cuts = upto[before]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; they need not be UTF-8."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.merges.known) or not self.merges.known[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        return self.merges.bytes.gather(ids)[0].astype(np.uint8).tobytes()


@lru_cache(maxsize=1)
def rank_encoder(path: str) -> RankEncoder:
    """The worker's encoder: what one task learnt serves the next."""
    return RankEncoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        sizes = np.cumsum([len(t) for t in texts])
        i = 0
        while i < len(texts):  # parts of about CHUNK characters
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK, side="right")))
            ids = rank_encoder(path).encode(texts[i:j])
            columns = [batch.column("doc_id").slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])
            i = j


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [rank_encoder(path).decode(np.frombuffer(b or b"", "<u4")) for b in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.binary())], [*batch.schema.names, "bytes"])


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ids (little-endian unsigned 32-bit numbers), by a file of ranks.

    Texts are split as the vocabulary's pattern does, and each piece is merged by itself: the pair of least rank first, of
    equal ones the leftmost. No special tokens. Null and empty texts have no ids. Null and repeated doc_ids pass as they are;
    extra columns are ignored. No documents: no rows. A very long text is one row of its task; a piece of more than WIDEST
    bytes is merged from a heap, in n log n steps. There is no shuffle; ``vocabulary`` is a path that every executor has.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(RANKS)
    return only(docs, doc_id="long", text="string").mapInArrow(lambda b: _encode(b, path), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``bytes``, what the ``ids`` of each row stand for; null ids give none, an unknown id fails the job.

    Ids may be cut anywhere, so bytes need not be UTF-8: cast them to string where they are a whole text.
    """
    small_batches(encoded.sparkSession)
    path = vocabulary or vocabulary_path(RANKS)
    kept = encoded.drop("bytes")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lambda b: _decode(b, path), f"{fields}, bytes binary")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from the ids and from the bytes they give back."""
    back = decode(encode(docs))
    return back.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))

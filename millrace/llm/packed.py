"""Many short byte strings at once, as numpy arrays: exact 128-bit keys, hashes of their content, and numbers for distinct ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Increment and multipliers of the splitmix64 finaliser.
GOLDEN, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Low k bytes of a word of 8.
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Strings of up to SHORT bytes are known by two words that hold all their bytes and their length.
SHORT = 15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def step(k: int) -> np.uint64:
    """``k`` increments, modulo 2^64."""
    return U64(k * int(GOLDEN) & (1 << 64) - 1)


def arrow_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings end to end, and where each begins (one place more than strings). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with 16 more behind them, so that two words can be read from any place."""
    return np.concatenate([data, np.zeros(16, np.uint8)])


def _words(pad: np.ndarray) -> np.ndarray:
    """The word of 8 bytes that begins at each place."""
    return np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))


def hashes(pad: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string ``pad[start:start + size]``: its words of 8 bytes are mixed in one after the other."""
    words = _words(pad)
    h = mix((words[start] & LOW_BYTES[np.minimum(size, 8)]) ^ (size.astype(U64) * GOLDEN))
    left, at = np.flatnonzero(size > 8), 8
    while left.size:
        h[left] = mix(h[left] * MIX2 + GOLDEN ^ (words[start[left] + at] & LOW_BYTES[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    return h


class Slots:
    """Open-addressing table from keys of two words (the second never 0) to numbers from 0."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.low, self.high, self.slot = np.zeros(self.mask + 1, U64), np.zeros(self.mask + 1, U64), np.zeros(self.mask + 1, np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low + high * GOLDEN) & U64(self.mask)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = self._home(low, high)
        there = self.high[at]
        same = (there == high) & (self.low[at] == low)
        out = np.where(same, self.slot[at], np.int32(-1)).astype(np.int64)
        left = np.flatnonzero(~same & (there != 0))
        while left.size:
            at[left] = (at[left] + 1) & self.mask
            there = self.high[at[left]]
            same = (there == high[left]) & (self.low[at[left]] == low[left])
            out[left[same]] = self.slot[at[left[same]]]
            left = left[~same & (there != 0)]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        at = self._home(low, high)
        while len(at):  # the first of those that want a free place gets it, the others go on to the next
            places, own = np.unique(at, return_index=True)
            own = own[self.high[places] == 0]
            self.low[at[own]], self.high[at[own]], self.slot[at[own]] = low[own], high[own], number[own]
            left = np.ones(len(at), bool)
            left[own] = False
            at, low, high, number = (at[left] + 1) & self.mask, low[left], high[left], number[left]


class Numbers:
    """Numbers distinct byte strings from 0 in the order they come; equal numbers are equal strings, whatever their hashes.

    Strings of up to SHORT bytes are compared by two words that hold them whole; longer ones are keys of a dictionary.
    """

    def __init__(self, bits: int = 22):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.slots, self.long, self.count = Slots(self.bits), {}, 0

    @property
    def full(self) -> bool:
        """Whether it is time to start anew: some three eighths of the places are taken."""
        return self.count > 3 << (self.bits - 3)

    def number(self, pad: np.ndarray, start: np.ndarray, size: np.ndarray, learn: Callable[[list[bytes]], None] | None = None) -> np.ndarray:
        """The number of each string; ``learn`` is told the new ones, in the order of their numbers."""
        words, short = _words(pad), size <= SHORT
        at, n = start[short], size[short]
        low = words[at] & LOW_BYTES[np.minimum(n, 8)]
        high = (words[at + 8] & LOW_BYTES[np.maximum(n - 8, 0)]) | (n.astype(U64) << U64(56)) | U64(1 << 63)
        got = self.slots.find(low, high)
        new = np.flatnonzero(got < 0)
        while new.size:  # keys of one hash are learnt in turns
            _, own = np.unique(mix(low[new] + high[new] * MIX2), return_index=True)
            own = new[own]
            if self.count + len(own) > self.slots.mask * 3 // 4:
                self._widen()
            self.slots.add(low[own], high[own], np.arange(self.count, self.count + len(own), dtype=np.int32))
            self._learn([pad[a : a + k].tobytes() for a, k in zip(at[own].tolist(), n[own].tolist(), strict=True)], learn)
            got[new] = self.slots.find(low[new], high[new])
            new = new[got[new] < 0]
        out = np.empty(len(start), np.int64)
        out[short] = got
        if len(n) < len(start):
            wide = np.flatnonzero(~short)
            strings = [pad[a : a + k].tobytes() for a, k in zip(start[wide].tolist(), size[wide].tolist(), strict=True)]
            fresh = [s for s in dict.fromkeys(strings) if s not in self.long]
            self.long.update(zip(fresh, range(self.count, self.count + len(fresh)), strict=True))
            self._learn(fresh, learn)
            out[wide] = [self.long[s] for s in strings]
        return out

    def _learn(self, strings: list[bytes], learn: Callable[[list[bytes]], None] | None) -> None:
        self.count += len(strings)
        if learn and strings:
            learn(strings)

    def _widen(self) -> None:
        old, self.bits = self.slots, self.bits + 1
        self.slots, held = Slots(self.bits), np.flatnonzero(old.high)
        self.slots.add(old.low[held], old.high[held], old.slot[held])


class Lists:
    """Numbered lists of ids, end to end in one array."""

    def __init__(self) -> None:
        self.offsets, self.flat, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = int(self.offsets[self.count]), len(lengths)
        while first + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[first : first + len(ids)] = ids
        self.offsets[self.count + 1 : self.count + n + 1] = first + np.cumsum(lengths)
        self.count += n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``numbers`` end to end, and where each begins (one place more than lists)."""
        lengths = self.offsets[numbers + 1] - self.offsets[numbers]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.offsets[numbers] - upto[:-1], lengths) + np.arange(upto[-1])], upto

"""Sketches over many tasks: each emits sparse counts of cells, Spark sums them block by block, and what matters becomes bitmaps."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from millrace.llm.common import small_batches

#: Cells of a block, as a power of two: what a task sums at once.
BLOCK_BITS = 20
PART = "sketch_row int, block int, cells binary"


def parts(cells: np.ndarray, sketch_row: int) -> list[tuple[int, int, bytes]]:
    """The counts of unsorted ``cells`` as a row per block: gaps between cells of one or two bytes, and counts of one byte,
    compressed. A gap too long for its width is bridged by entries of count 0. Counts end at 255: sums stay at least as large as any
    threshold of that much.
    """
    if not len(cells):
        return []
    cells = np.sort(cells)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    counts = np.minimum(np.diff(np.append(first, len(cells))), 255).astype(np.uint8)
    cells = cells[first].astype(np.int64)
    blocks = cells >> BLOCK_BITS
    bounds = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
    out = []
    for a, z in zip(bounds.tolist(), np.append(bounds[1:], len(cells)).tolist(), strict=True):
        own = cells[a:z] & ((1 << BLOCK_BITS) - 1)
        gap = np.diff(own, prepend=0)
        kind, most = (np.uint8, 255) if z - a > 1 << (BLOCK_BITS - 9) else (np.dtype("<u2"), 65535)
        bridges = gap // most
        at = np.cumsum(bridges) + np.arange(z - a)
        gaps, seen = np.full(at[-1] + 1, most, kind), np.zeros(at[-1] + 1, np.uint8)
        gaps[at], seen[at] = gap % most, counts[a:z]
        out.append((sketch_row, int(blocks[a]), bytes([gaps.itemsize]) + len(gaps).to_bytes(4, "little") + pa.compress(gaps.tobytes() + seen.tobytes(), codec="zstd", asbytes=True)))
    return out


def part_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["sketch_row", "block", "cells"])


def _add(total: np.ndarray, cells: bytes) -> None:
    width, n = cells[0], int.from_bytes(cells[1:5], "little")
    cells = pa.decompress(cells[5:], n * (width + 1), codec="zstd", asbytes=True)
    at = np.cumsum(np.frombuffer(cells, np.uint8 if width == 1 else "<u2", n), dtype=np.int64)
    seen = np.frombuffer(cells, np.uint8, n, n * width)
    total[at[seen > 0]] += seen[seen > 0]


def _sum(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    key, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

    def bits() -> pa.RecordBatch:
        return part_batch([(*key, zlib.compress(np.packbits(total >= threshold).tobytes(), 1))])

    for batch in batches:
        for own in zip(*(batch.column(k).to_pylist() for k in ("sketch_row", "block", "cells")), strict=True):
            if own[:2] != key:
                if key is not None and (total >= threshold).any():
                    yield bits()
                key = own[:2]
                total[:] = 0
            _add(total, own[2])
    if key is not None and (total >= threshold).any():
        yield bits()


class Bitmaps:
    """Which cells of each row of a sketch reach the threshold."""

    def __init__(self, held: list[tuple[int, int, bytes]], rows: int, bits: int):
        self.cells = np.zeros((rows, max(1, 1 << bits >> 3)), np.uint8)
        size = 1 << BLOCK_BITS >> 3
        for row, block, data in held:
            own = np.frombuffer(zlib.decompress(data), np.uint8)
            room = self.cells[row, block * size : (block + 1) * size]
            room[:] = own[: len(room)]

    def has(self, row: int, cells: np.ndarray) -> np.ndarray:
        return (self.cells[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def merged(sparse: DataFrame, rows: int, bits: int, threshold: int) -> Broadcast:
    """Sums parts (PART) from all tasks; the broadcast holds one bit per cell, whether its sum is at least ``threshold`` (255 at most).

    A task sums the parts of one block after the other, however many there are. The driver and the broadcast hold
    ``rows * 2 ** bits / 8`` bytes at most, less by compression; ``bits`` is the caller's bound.
    """
    if not 0 < threshold <= 255:
        raise ValueError("counts of a cell end at 255")
    spark = sparse.sparkSession
    small_batches(spark)
    ordered = sparse.repartition("sketch_row", "block").sortWithinPartitions("sketch_row", "block")
    held = [(r["sketch_row"], r["block"], bytes(r["cells"])) for r in ordered.mapInArrow(lambda b: _sum(b, threshold), PART).collect()]
    return spark.sparkContext.broadcast((uuid.uuid4().hex, held, rows, bits))


_READY: dict[str, Bitmaps] = {}


def bitmaps(shared: Broadcast) -> Bitmaps:
    """The broadcast's bitmaps, laid out once per worker."""
    key, *rest = shared.value
    if key not in _READY:
        _READY.clear()
        _READY[key] = Bitmaps(*rest)
    return _READY[key]

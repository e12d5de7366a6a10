"""CRC-32C of many byte strings at once, and the masked form that record files carry.

With a start of zero the checksum is linear and leading zeros do not count. So each string is padded in front to whole
blocks, all blocks are summed side by side, and a block's sum is then shifted by the bytes after it, bit by bit of their count.
"""

from __future__ import annotations

import numpy as np

U32 = np.uint32
#: Castagnoli polynomial, reflected; and the constant that masks a checksum. Fixed values of the format.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
BLOCK = 64


def _byte_tables() -> list[np.ndarray]:
    first = np.arange(256, dtype=U32)
    for _ in range(8):
        first = np.where(first & U32(1), (first >> U32(1)) ^ U32(POLYNOMIAL), first >> U32(1)).astype(U32)
    tables = [first]
    for _ in range(3):
        tables.append(first[tables[-1] & U32(255)] ^ (tables[-1] >> U32(8)))
    return tables


TABLES = _byte_tables()


def _by_bytes(tables: list[np.ndarray], state: np.ndarray) -> np.ndarray:
    return tables[0][state & U32(255)] ^ tables[1][(state >> U32(8)) & U32(255)] ^ tables[2][(state >> U32(16)) & U32(255)] ^ tables[3][state >> U32(24)]


def _shift_tables(images: np.ndarray) -> list[np.ndarray]:
    """From a linear map's images of the 32 single bits to a table for each byte."""
    value = np.arange(256)
    out = []
    for byte in range(4):
        table = np.zeros(256, U32)
        for bit in range(8):
            table ^= np.where(value >> bit & 1, images[8 * byte + bit], U32(0)).astype(U32)
        out.append(table)
    return out


def _shifts() -> list[list[np.ndarray]]:
    """Tables that shift a state by BLOCK * 2^k zero bytes, for k up to 30."""
    images = U32(1) << np.arange(32, dtype=U32)
    for _ in range(BLOCK):
        images = TABLES[0][images & U32(255)] ^ (images >> U32(8))
    out = []
    for _ in range(31):
        tables = _shift_tables(images)
        out.append(tables)
        images = _by_bytes(tables, images)
    return out


SHIFTS = _shifts()


def checksums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of data[offsets[i]:offsets[i + 1]] for each i; every string has four bytes at least."""
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros(0, U32)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    padded = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    begins = ends * BLOCK - sizes
    padded[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    for k in range(4):  # a start of all ones is the same as the first four bytes inverted
        padded[begins + k] ^= 255
    words = padded.view("<u4").reshape(-1, BLOCK // 4)
    state = np.zeros(len(words), U32)
    reverse = TABLES[::-1]
    for k in range(BLOCK // 4):
        state = _by_bytes(reverse, state ^ words[:, k])
    behind = np.repeat(ends, blocks) - 1 - np.arange(len(words))
    for k in range(int(behind.max()).bit_length()):
        at = np.flatnonzero(behind >> k & 1)
        state[at] = _by_bytes(SHIFTS[k], state[at])
    return np.bitwise_xor.reduceat(state, ends - blocks) ^ U32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums stays sound."""
    return ((crc >> U32(15)) | (crc << U32(17))) + U32(MASK_DELTA)

"""CRC-32C of many byte strings at once, and its masked form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

BLOCK = 256
POLYNOMIAL = 0x82F63B78  # reflected Castagnoli
MASK_DELTA = 0xA282EAD8  # fixed value of the record format


@cache
def distance_tables() -> np.ndarray:
    """[d][byte]: what a byte that stands d places before a block's end adds to the raw remainder."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1)
    tables = np.empty((BLOCK, 256), np.uint32)
    tables[0] = first
    for d in range(1, BLOCK):
        tables[d] = first[tables[d - 1] & 0xFF] ^ (tables[d - 1] >> 8)
    return tables


@cache
def byte_table() -> list[int]:
    return distance_tables()[0].tolist()


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def crc32c_many(parts: Sequence[bytes]) -> np.ndarray:
    """Checksums of all parts: remainders of blocks by table look-ups over arrays, then chained block by block."""
    out = np.zeros(len(parts), np.uint32)
    table = byte_table()
    long = [i for i, p in enumerate(parts) if len(p) >= 16]
    for i, p in enumerate(parts):
        if len(p) < 16:
            crc = 0xFFFFFFFF
            for b in p:
                crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
            out[i] = crc ^ 0xFFFFFFFF
    if not long:
        return out
    blocks = np.array([-(-len(parts[i]) // BLOCK) for i in long])
    rows = np.zeros((int(blocks.sum()), BLOCK), np.uint8)  # zeros in front do not change a raw remainder
    ends = np.cumsum(blocks)
    flat = rows.reshape(-1)
    for i, end in zip(long, ends, strict=True):
        data = np.frombuffer(parts[i], np.uint8)
        at = int(end) * BLOCK - len(data)
        flat[at : at + len(data)] = data
        flat[at : at + 4] ^= 0xFF  # the register starts with ones
    tables = distance_tables()
    remainders = np.zeros(len(rows), np.uint32)
    for d in range(BLOCK):
        remainders ^= tables[d][rows[:, BLOCK - 1 - d]]
    starts = ends - blocks
    crc = np.zeros(len(long), np.uint32)
    for k in range(int(blocks.max())):
        live = blocks > k
        c = crc[live]
        moved = tables[BLOCK - 1][c & 0xFF] ^ tables[BLOCK - 2][c >> 8 & 0xFF] ^ tables[BLOCK - 3][c >> 16 & 0xFF] ^ tables[BLOCK - 4][c >> 24]
        crc[live] = moved ^ remainders[starts[live] + k]
    out[long] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum of data that holds checksums stays useful."""
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF

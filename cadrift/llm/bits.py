"""Sets of keys as bit arrays of bounded size, for tasks that leave out what cannot count.

A key that is not in the set may be found there, so what passes is counted again, exactly; a key
of the set is always found. Beyond ``most`` bits the array stays as large and lets more pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
KEY_BITS = 40
PACKED = "block int, gaps binary, counts binary"
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of 64-bit values."""
    with np.errstate(over="ignore"):
        x = np.zeros(len(h), np.uint64)
        for k in range(h.shape[1]):
            x = (x ^ h[:, k]) * np.uint64(MIX[0])
            x = (x ^ x >> np.uint64(29)) * np.uint64(MIX[1])
            x ^= x >> np.uint64(32)
    return x


class Bits:
    """Test of 64-bit hashes; ``words`` holds the array, ``size`` the logarithm of its length."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size

    def have(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) >> np.uint64(64 - self.size)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_of(keys: DataFrame, h: Column, rows: int, most: int = 28) -> Bits:
    """Bit array of the hashes ``h`` of ``keys``, 16 bits a row but at most 2^``most`` (32 MB) in all.

    The array is put together by 64-bit words in a grouped sum; only it reaches the driver.
    """
    size = min(most, max(10, int(16 * max(rows, 1) - 1).bit_length()))
    at = F.shiftrightunsigned(h, 64 - size)
    words = keys.select(F.shiftright(at, 6).cast("int").alias("w"), at.bitwiseAND(63).cast("int").alias("b"))
    grouped = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, np.int64)
    out[grouped.column("w").to_numpy()] = grouped.column("bits").to_numpy()
    return Bits(out.view(np.uint64), size)


def planes(x: np.ndarray) -> bytes:
    """32-bit integers, all first bytes first, which packs well where they are small."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.uint64)


def packed(keys: np.ndarray, counts: np.ndarray, blocks: int):
    """Rows of ``PACKED`` for sorted distinct keys of ``KEY_BITS`` bits: a block is their first ``blocks``
    bits, 8 or more, and holds the gaps between them and their counts."""
    of, first = np.unique(keys >> np.uint64(KEY_BITS - blocks), return_index=True)
    low = keys & np.uint64((1 << KEY_BITS - blocks) - 1)
    ends = [*first[1:].tolist(), len(keys)]
    gaps = [planes(np.diff(low[i:j], prepend=np.uint64(0))) for i, j in zip(first, ends)]
    for i in range(0, len(of), 1 << 12):
        j = min(i + (1 << 12), len(of))
        yield pa.RecordBatch.from_arrays([pa.array(of[i:j].astype(np.int32)), pa.array(gaps[i:j], pa.binary()), pa.array([planes(counts[x:y]) for x, y in zip(first[i:j], ends[i:j])], pa.binary())],
                                         names=["block", "gaps", "counts"])


def sum_block(least: int, blocks: int):
    """``h``: keys of a block of ``PACKED`` rows with counts of ``least`` or more in all, as the first bits of 64."""
    def run(rows: pa.Table) -> pa.Table:
        low = np.concatenate([np.cumsum(from_planes(x), dtype=np.uint64) for x in rows.column("gaps").to_pylist()])
        n = np.concatenate([from_planes(x) for x in rows.column("counts").to_pylist()])
        u, at = np.unique(low, return_inverse=True)
        u = u[np.bincount(at, n, len(u)) >= least] | np.uint64(rows.column("block")[0].as_py() << KEY_BITS - blocks)
        return pa.table({"h": pa.array((u << np.uint64(64 - KEY_BITS)).view(np.int64))})
    return run

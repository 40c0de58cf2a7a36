"""A map of bits that tells which 64-bit hashes may be in a table, never missing one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most bits in all (32 MB); with more hashes more strangers pass.
BITS_EACH, MOST_BITS = 16, 1 << 28


def build(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of a written table's column of well spread 64-bit numbers, two for each number."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(15, (hashes.count() * BITS_EACH).bit_length()))
    at = lambda shift: F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(size - 1))
    # numbers from 1 on are dealt into parts of 32768 bits
    bits = hashes.select(F.explode(F.array(at(0), at(32))).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((size >> 15, 4096), np.uint8)
    for r in parts.collect():
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the table."""
    mask = np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) & mask
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found

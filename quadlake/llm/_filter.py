"""A filter of bounded size that all tasks hold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits as a power of two: so many for each hash, and at most (32 MB).
BITS_EACH, MOST_BITS = 8, 28


class Filter:
    """Tells of a hash whether a table (column seed) may have it: two bits for each, from different ends of the hash. Nothing in the table is
    ever denied."""

    def __init__(self, seeds: DataFrame, count: int):
        self.bits = max(12, min(MOST_BITS, BITS_EACH + math.ceil(math.log2(max(1, count)))))
        low = F.col("seed").bitwiseAND(F.lit((1 << self.bits) - 1))
        slot = F.explode(F.array(low, F.shiftrightunsigned("seed", 64 - self.bits))).alias("slot")
        # At most 2**(MOST_BITS - 6) rows reach the driver.
        got = seeds.select(slot).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("w")).toArrow()
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)
        self.table[np.asarray(got.column("at"))] = np.asarray(got.column("w")).view(np.uint64)

        self.table = self.table.view(np.uint8)  # little-endian: bit k of the slots is bit k % 8 of byte k // 8

    def _set(self, slots: np.ndarray) -> np.ndarray:
        return (self.table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1

    def passing(self, seeds: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self._set((seeds & np.uint64((1 << self.bits) - 1)).view(np.int64)))
        return at[self._set((seeds[at] >> np.uint64(64 - self.bits)).view(np.int64)) == 1]

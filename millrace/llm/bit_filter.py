"""A filter of fixed size that tells which hashes may be among some: never misses one, whatever the number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (as bits): 4 MB.
BITS = 25
_SHIFTS = (0, 20, 39)


def build(hashes: DataFrame) -> np.ndarray:
    """The filter of a one-column table of 64-bit hashes; at most 2 ** (BITS - 6) words reach the driver."""
    key = hashes.columns[0]
    spots = hashes.select(F.explode(F.array(*[F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << BITS) - 1)) for s in _SHIFTS])).alias("spot"))
    words = (spots.groupBy(F.shiftright("spot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned 64-bit) may be in the filter."""
    out = np.ones(len(keys), bool)
    for s in _SHIFTS:
        spot = (keys >> np.uint64(s)) & np.uint64((1 << BITS) - 1)
        out &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return out

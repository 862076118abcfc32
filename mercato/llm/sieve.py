"""Sets of 64-bit keys as bit arrays of fixed size.

Every key that was marked passes; another key passes now and then.  The size does not
grow with the number of keys, so a sieve can be handed to every task; the users
below lose nothing by a key too many.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark(keys: DataFrame, bits: int = 1 << 25) -> np.ndarray:
    """Bytes of a sieve of ``bits`` bits (a power of two) with the keys of column ``key`` (long); bits / 64 rows at most reach the driver."""
    low, high = (F.expr(f"{x} & {bits - 1}") for x in ("key", "shiftrightunsigned(key, 32)"))
    at = keys.select(F.explode(F.array(low, high)).alias("at"))
    marks = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    return out.view(np.uint8)


def held(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the sieve lets each unsigned 64-bit key pass."""
    last = np.uint64(8 * len(sieve) - 1)
    a, b = key & last, (key >> np.uint64(32)) & last
    return (((sieve[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (sieve[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)

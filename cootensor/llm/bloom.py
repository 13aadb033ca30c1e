"""Bloom filters of fixed size over 64-bit keys, gathered on Spark and broadcast.

They thin out rows before an exact join; they never decide a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, mix

FILTER_BITS = 1 << 26      # 8 MB
PROBES = 3


def _places(keys: np.ndarray) -> list[np.ndarray]:
    return [(mix(keys + U64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(FILTER_BITS)).astype(np.int64) for i in range(PROBES)]


def key_filter(keys: DataFrame, col: str):
    """Broadcast bit table (``FILTER_BITS`` bits as 64-bit words) over a long column."""
    def places(batches):
        for b in batches:
            h = np.unique(np.concatenate(_places(b.column(0).to_numpy().view(U64))))
            word = h >> 6
            at = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(np.left_shift(U64(1), (h & 63).astype(U64)), at) if len(h) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(bits.view(np.int64))], names=["w", "v"])

    words = keys.select(F.col(col)).mapInArrow(places, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    if len(words):
        table[words["w"].to_numpy()] = words["v"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for h in _places(keys.view(U64)):
        ok &= (table[h >> 6] >> (h & 63)) & 1 == 1
    return ok

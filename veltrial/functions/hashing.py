"""MurmurHash3 (x86, 32 bit) of strings as an Arrow-batched column function.

The engine's own ``hash`` differs: its seed is fixed, and it mixes the bytes
behind the last block of four one by one.  Here a batch is sorted into groups of
equal byte length, and each group is hashed as one matrix, so keys of any mix of
widths are allowed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of MurmurHash3.
C1, C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
M5, N5 = np.uint32(5), np.uint32(0xE6546B64)
F1, F2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_matrix(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the rows of a (n, width) uint8 matrix."""
    n, width = keys.shape
    h = np.full(n, seed, np.uint32)
    whole = width // 4 * 4
    blocks = np.ascontiguousarray(keys[:, :whole]).view("<u4") if whole else np.zeros((n, 0), np.uint32)
    for k in blocks.T:
        h ^= _rotate(k * C1, 15) * C2
        h = _rotate(h, 13) * M5 + N5
    if width > whole:
        tail = np.zeros(n, np.uint32)
        for i in range(width - whole):
            tail |= keys[:, whole + i].astype(np.uint32) << np.uint32(8 * i)
        h ^= _rotate(tail * C1, 15) * C2
    h ^= np.uint32(width)
    h ^= h >> np.uint32(16)
    h *= F1
    h ^= h >> np.uint32(13)
    h *= F2
    return h ^ (h >> np.uint32(16))


def murmur3_strings(values: pd.Series, seed: int = 0) -> np.ndarray:
    """int64 hashes; a missing value hashes as the empty string."""
    column = pa.array(values.fillna(""), pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    width = np.diff(offsets)
    out = np.empty(len(column), np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = murmur3_matrix(data[offsets[at][:, None] + np.arange(w)], seed)
    return out


def murmur3_32(column: Column | str, seed: int = 0) -> Column:
    """Unsigned 32-bit hash as a long; NULL stays NULL."""
    column = F.col(column) if isinstance(column, str) else column

    def batch(values: pd.Series) -> pd.Series:
        return pd.Series(murmur3_strings(values, seed))

    return F.when(column.isNotNull(), F.pandas_udf(batch, "long")(column))

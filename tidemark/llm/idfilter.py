"""Semi and anti joins of wide rows with a set of ids that shuffle few of the wide rows.

A Bloom filter of the ids, of a size bounded by MAX_BITS, is broadcast; rows that it excludes are decided at once, and only
the others are joined by a shuffle, which makes the result exact. With more ids than MAX_BITS / BITS_PER_ID more rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import filter_bits
from .words import mix

HASHES = 4
CHUNK = 1 << 16


def _positions(ids: np.ndarray, bits: int) -> np.ndarray:
    x = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix(x) | np.uint64(1)
    return np.stack([(x + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)], axis=1).astype(np.int64)


def bloom(ids: DataFrame) -> bytes:
    """Bit map of a one-column table of ids (long, not null)."""
    bits, name = filter_bits(ids.count()), ids.columns[0]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[_positions(batch[name].to_numpy(np.int64), bits).ravel()] = True
        packed = np.packbits(seen).reshape(-1, CHUNK // 8)
        for k in np.flatnonzero(packed.any(axis=1)):
            yield pd.DataFrame({"chunk": [k], "part": [packed[k].tobytes()]})

    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for chunk, part in ids.mapInPandas(mark, "chunk int, part binary").toLocalIterator():
        out[chunk] |= np.frombuffer(part, np.uint8)
    return out.tobytes()


def maybe(ids: np.ndarray, bitmap: bytes) -> np.ndarray:
    """Which of the ids a filter doesn't exclude."""
    bits = np.frombuffer(bitmap, np.uint8)
    at = _positions(ids, len(bits) * 8)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def maybe_in(ids: DataFrame):
    shared = ids.sparkSession.sparkContext.broadcast(bloom(ids))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=bool)
        return pd.Series(maybe(values.to_numpy(np.int64), shared.value))

    return test


def only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is among ids (stored)."""
    ids, test = ids.toDF(column), maybe_in(ids)
    return rows.where(F.col(column).isNotNull()).where(test(column)).join(ids, column, "left_semi")


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is null or not among ids (stored)."""
    ids, test = ids.toDF(column), maybe_in(ids)
    may: Column = test(F.coalesce(F.col(column), F.lit(0)))
    return rows.where(F.col(column).isNull() | ~may).unionByName(rows.where(F.col(column).isNotNull() & may).join(ids, column, "left_anti"))

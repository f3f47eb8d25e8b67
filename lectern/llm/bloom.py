"""A Bloom filter of ids: drops rows without a partner before anything is made of them or sent anywhere.

Its size is ``BITS`` bits an id and never more than ``MOST_BITS``; beyond that it lets more rows through, and an
exact join always follows, so results do not depend on it. It is put together by a grouped aggregate of 64-bit
words, which is what reaches the driver: two bytes an id, at most 64 MB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import mix

BITS, MOST_BITS = 16, 1 << 29
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = ids.view(np.uint64)
    mask = np.uint64(bits - 1)
    return mix(h + np.uint64(1)) & mask, mix(h ^ _SECOND) & mask


def bloom(ids: DataFrame, column: str = "id") -> np.ndarray:
    """The filter's words. ``ids`` is read twice, so it should be a written table."""
    n = ids.count()
    bits = min(MOST_BITS, 1 << max(6, (BITS * max(n, 1) - 1).bit_length()))

    def words(parts):
        import pyarrow as pa

        for b in parts:
            at = np.concatenate(_places(b.column("id").to_numpy(zero_copy_only=False), bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            held = np.bitwise_or.reduceat(bit, first) if len(word) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(held.view(np.int64))], names=["word", "held"])

    each = ids.select(F.col(column).cast("long").alias("id")).filter("id is not null").mapInArrow(words, "word long, held long")
    found = each.groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["held"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False only for ids that are not in the filter."""
    out = np.ones(len(ids), bool)
    for at in _places(ids, len(words) * 64):
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out

"""Bloom filters over 64-bit keys as plain bit arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.words import mix

HASHES = 5
#: Filters that one task joins.
FAN = 16


def size_for(keys: int, most_bits: int = 1 << 28) -> int:
    """Bits, a power of two, for about 1 % of false positives; most_bits bounds the filter, beyond which more keys pass unduly."""
    return min(most_bits, max(1 << 10, 1 << int(np.ceil(np.log2(max(keys, 1) * 10)))))


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a = mix(keys.astype(np.uint64))
    b = mix(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k in range(HASHES):
        yield ((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64)


def build(keys: np.ndarray, bits: int) -> np.ndarray:
    table = np.zeros(bits, bool)
    for at in _places(keys, bits):
        table[at] = True
    return np.packbits(table, bitorder="little")


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _places(keys, len(table) * 8):
        found &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def distributed(keys: DataFrame, count: int) -> np.ndarray:
    """One filter over the only column of keys: each partition sets its bits, and a tree of tasks joins them, FAN at a time. The filter, not the keys, comes to the driver."""
    bits = size_for(count)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            if b.num_rows:
                own = build(b.column(0).to_numpy(zero_copy_only=False), bits)
                table = own if table is None else table | own
        if table is not None:
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                table |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])

    # the partitions' filters are joined FAN at a time, until one is left
    filters = keys.mapInArrow(local, "bits binary")
    n = filters.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        filters = filters.repartition(n).mapInArrow(join, "bits binary")
    rows = filters.collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out |= np.frombuffer(r[0], np.uint8)
    return out

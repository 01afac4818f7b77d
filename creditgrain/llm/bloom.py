"""Bloom filters of a fixed size, built by the tasks and small enough for the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mix

BITS = 26  # 8 MB


def _places(keys: np.ndarray) -> list[np.ndarray]:
    spread = mix(keys)
    mask = np.uint64((1 << BITS) - 1)
    return [(spread & mask).astype(np.int64), ((spread >> np.uint64(30)) & mask).astype(np.int64)]


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << BITS, bool)
    for batch in batches:
        for places in _places(column(batch, "key").view(np.uint64)):
            held[places] = True
    packed = np.packbits(held, bitorder="little").view(np.int64)
    used = np.flatnonzero(packed)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed[used])], ["place", "bits"])


def bloom_of(keys: DataFrame, name: str) -> np.ndarray:
    """The filter of a column of longs, as bytes. However many there are, it has one size:
    beyond some millions it lets more through, which costs time and no result."""
    bits = (
        keys.select(F.col(name).alias("key"))
        .mapInArrow(_set, "place int, bits long")
        .groupBy("place")
        .agg(F.bit_or("bits").alias("bits"))
    )
    packed = np.zeros(1 << (BITS - 6), np.int64)
    for batch in bits.toArrow().to_batches():  # at most 2**(BITS - 6) rows
        packed[column(batch, "place")] = column(batch, "bits")
    return packed.view(np.uint8)


def may_hold(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = _places(keys)
    return ((packed[one >> 3] >> (one & 7)) & (packed[two >> 3] >> (two & 7)) & 1).astype(bool)

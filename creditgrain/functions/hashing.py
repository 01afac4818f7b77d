"""Seeded draws that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(key: Column, seed: int) -> Column:
    """A uniform 60-bit integer for ``key``: the first 15 hex digits of md5(key:seed)."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_bin(hashed: Column, bits: int) -> Column:
    """The leading ``bits`` of a hash; bins are even and keep the hash order."""
    return F.shiftright(hashed, HASH_BITS - bits)

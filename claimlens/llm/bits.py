"""Bit maps built from rows and sent to tasks; their size follows a count, within a fixed limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and greatest number of bits (128 KB and 32 MB), bits for each key, and slices that a map is built in.
LEAST, MOST, EACH, SLICES = 1 << 20, 1 << 28, 16, 64


class BitMap:
    """A set of hashes, with false hits: a hash is known by its last bits."""

    def __init__(self, bits: bytes):
        self.bits, self.last = bits, 8 * len(bits) - 1

    def __contains__(self, key: int) -> bool:
        bit = key & self.last
        return bool(self.bits[bit >> 3] & (128 >> (bit & 7)))

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """As `in`, for an array of unsigned longs."""
        bit = keys & np.uint64(self.last)
        found = np.frombuffer(self.bits, np.uint8)[(bit >> np.uint64(3)).astype(np.int64)]
        return (found & (128 >> (bit & np.uint64(7)).astype(np.uint8))) != 0


def size_for(keys: int) -> int:
    """Bits of a map for so many keys, a power of two. Beyond MOST / EACH keys false hits become more frequent;
    whoever uses a map must stay right (and only do more work) with any number of them."""
    n = LEAST
    while n < min(MOST, EACH * keys):
        n *= 2
    return n


def _slice(width: int):
    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        bits[np.array(rows.column("bit")) % width] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return build


def bit_map(keys: DataFrame, key: Column) -> BitMap:
    """The map of the longs that key gives for the rows of keys."""
    n = size_for(keys.count())
    width = n // SLICES
    bits = keys.select(key.bitwiseAND(F.lit(n - 1)).alias("bit")).distinct().withColumn("slice", F.floor(F.col("bit") / width).cast("int"))
    found = {r["slice"]: bytes(r["bits"]) for r in bits.groupBy("slice").applyInArrow(_slice(width), "slice int, bits binary").collect()}
    return BitMap(b"".join(found.get(i, bytes(width // 8)) for i in range(SLICES)))

"""A Bloom filter over 64-bit key hashes, built in segments by many tasks and broadcast whole.

A key belongs to one segment by its upper bits and sets a few bits inside it by
its others, so that a segment is built from its own keys alone. No key is ever
reported absent that is there; of absent ones about one in two hundred passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits a key and probes a key.
BITS_A_KEY, PROBES = 12, 6
#: Bits of a segment, at most: what one task builds.
SEGMENT_BITS = 1 << 23
#: The filter is broadcast only up to this size.
MOST_BYTES = 256 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Bloom:
    """Bits in one array of bytes; ``segments`` of ``bits`` each, both powers of two."""

    def __init__(self, segments: int, bits: int):
        self.segments, self.bits = segments, bits
        self.data = np.zeros(segments * bits // 8, np.uint8)

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.astype(np.uint64) >> np.uint64(32)).astype(np.int64) & (self.segments - 1)

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Positions inside a key's segment, a row for each probe."""
        a, b = (hashes.astype(np.uint64) * m for m in _MIX)
        a, b = a ^ a >> np.uint64(31), b ^ b >> np.uint64(29) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b >> np.uint64(20)) & np.uint64(self.bits - 1) for i in range(PROBES)]).astype(np.int64)

    def built(self, hashes: np.ndarray) -> bytes:
        """The bytes of one segment, of its keys."""
        flags = np.zeros(self.bits, bool)
        flags[self.positions(hashes).ravel()] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.positions(hashes) + self.segment(hashes) * self.bits
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def build(keys: DataFrame, most_bytes: int = MOST_BYTES, segment_bits: int = SEGMENT_BITS) -> Bloom | None:
    """The filter of ``keys`` (one bigint column of hashes); None where it would be above ``most_bytes``.

    It is sized by the number of rows, repeated ones included. Nulls are no keys.
    """
    name = keys.columns[0]
    wanted = max(1024, keys.count() * BITS_A_KEY)
    total = 1 << (wanted - 1).bit_length()
    if total // 8 > most_bytes:
        return None
    bits = min(total, segment_bits)
    bloom = Bloom(total // bits, bits)
    segments, size = bloom.segments, bloom.bits

    def one(part: pd.DataFrame) -> pd.DataFrame:
        hashes = part["h"].to_numpy()
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "data": [Bloom(1, size).built(hashes)]})

    own = keys.select(F.col(name).alias("h")).where("h is not null").distinct()
    own = own.withColumn("segment", F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(segments - 1)))
    for row in own.groupBy("segment").applyInPandas(one, "segment bigint, data binary").toLocalIterator():  # most_bytes in all
        at = row.segment * bits // 8
        bloom.data[at : at + bits // 8] = np.frombuffer(row.data, np.uint8)
    return bloom


def may_hold(bloom: Bloom | None, hashes: Column, spark) -> Column:
    """Whether the filter may hold a hash; always so without a filter."""
    if bloom is None:
        return F.lit(True)
    shared = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf(BooleanType())
    def probe(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(column.fill_null(0).to_numpy()))

    return probe(hashes)

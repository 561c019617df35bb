"""Bloom filter: bit positions as rows, membership by a join or on a bounded bitmap."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.hashing import canonical, xxh64

SEEDS = (0xC0FFEE, 0xBEEF)
MAX_BITS = 2**33
#: Bits of a filter that may be brought to the driver: 128 MB.
COLLECT_BITS = 2**30


def sizing(capacity: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for the wanted share of false positives."""
    if capacity < 1 or not 0 < rate < 1:
        raise ValueError("capacity must be positive, the rate between 0 and 1")
    bits = max(64, math.ceil(-capacity * math.log(rate) / math.log(2) ** 2))
    if bits > MAX_BITS:
        raise ValueError(f"{bits} bits exceed {MAX_BITS}")
    return bits, max(1, math.ceil(bits / capacity * math.log(2)))


def lossy_sizing(capacity: int, rate: float) -> tuple[int, int]:
    """sizing() with arguments moved into their ranges."""
    return sizing(max(1, capacity), min(0.5, max(1e-12, rate if rate == rate else 0.5)))


def positions(value: Column, bits: int, hashes: int) -> Column:
    """Array of (h1 + i * h2 mod 2**64) mod bits, in longs: the hashes are taken as two halves of 32 bits, so that nothing overflows."""
    half = 2**32 - 1
    low, high = lambda x: x.bitwiseAND(F.lit(half)), lambda x: F.shiftrightunsigned(x, 32)
    h1, h2 = (xxh64(value, s) for s in SEEDS)

    def position(i: int) -> Column:
        lo = low(h1) + low(h2) * i
        hi = low(high(h1) + high(h2) * i + high(lo))
        lo = low(lo)
        out = hi % bits
        for part in (F.shiftrightunsigned(lo, 16), lo.bitwiseAND(F.lit(0xFFFF))):
            out = (out * 65536 + part) % bits
        return out

    return F.array(*map(position, range(hashes)))


def set_bits(df: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """bit: the different set bits of the column's values, nulls left out."""
    rows = df.filter(F.col(f"`{column}`").isNotNull())
    return rows.select(F.explode(positions(canonical(df, column), bits, hashes)).alias("bit")).distinct()


def merge(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.distinct()


def contains(probe: DataFrame, column: str, filter_bits: DataFrame, bits: int, hashes: int, flag: str = "maybe") -> DataFrame:
    """Each different value of the probe's column with whether all its bits are set: a join on bits, whatever their number."""
    values = probe.filter(F.col(f"`{column}`").isNotNull()).select(column).distinct()
    asked = values.select(column, F.explode(F.array_distinct(positions(canonical(probe, column), bits, hashes))).alias("bit"))
    found = asked.join(filter_bits.withColumn("set", F.lit(1)), "bit", "left")
    return found.groupBy(column).agg((F.count("set") == F.count("*")).alias(flag))


@dataclass
class BloomFilter:
    bits: bytes
    num_hashes: int
    num_bits: int

    def __post_init__(self):
        if not 1 <= self.num_bits <= MAX_BITS or self.num_hashes < 1 or len(self.bits) != -(-self.num_bits // 8):
            raise ValueError("bits and their number do not agree")

    @classmethod
    def collect(cls, bit_rows: DataFrame, num_bits: int, num_hashes: int) -> BloomFilter:
        """Bits are packed to 32-bit words by the executors and come as Arrow columns: 12 bytes for each word that is not zero."""
        if num_bits > COLLECT_BITS:
            raise ValueError(f"{num_bits} bits are too many for the driver ({COLLECT_BITS}); contains() joins them")
        word, place = F.floor(F.col("bit") / 32), F.pow(F.lit(2), F.col("bit") % 32).cast("long")
        packed = bit_rows.groupBy(word.alias("word")).agg(F.sum(place).alias("value")).toArrow()
        words = np.zeros(-(-num_bits // 32), "<u4")
        words[packed["word"].to_numpy()] = packed["value"].to_numpy().astype("<u4")
        return cls(words.tobytes()[: -(-num_bits // 8)], num_hashes, num_bits)

    def contains(self, value: bytes) -> bool:
        import xxhash

        h1, h2 = (xxhash.xxh64_intdigest(value, s) for s in SEEDS)
        return all(self.bits[b >> 3] >> (b & 7) & 1 for b in ((h1 + i * h2) % 2**64 % self.num_bits for i in range(self.num_hashes)))

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", len(self.bits)) + self.bits + struct.pack("<IQ", self.num_hashes, self.num_bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        if len(data) < 20 or struct.unpack_from("<Q", data)[0] != len(data) - 20:
            raise ValueError("bits do not fill the payload")
        hashes, bits = struct.unpack_from("<IQ", data, len(data) - 12)
        return cls(data[8:-12], hashes, bits)

"""Count-Min sketch: counters by a grouped sum, point estimates and a sound maximum."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.hashing import canonical, unsigned_mod, xxh64

SEED = 0x1010D017
SATURATED = 2**32 - 1
DEPTH, WIDTH = 5, 1024


def sizing(error: float, failure: float) -> tuple[int, int]:
    """(depth, width) for an overcount of at most error * total, but for a share of failure."""
    return max(1, math.ceil(math.log(1 / failure))), max(1, math.ceil(math.e / error))


def places(value: Column, depth: int, width: int) -> Column:
    """One struct (row, pos) for each of the sketch's rows."""
    return F.array(*[F.struct(F.lit(r).alias("row"), unsigned_mod(xxh64(value, SEED ^ r), width).alias("pos")) for r in range(depth)])


def counters(df: DataFrame, column: str, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """row, pos, cnt: non-zero counters, nulls left out. Values are counted before they are placed."""
    values = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(canonical(df, column).alias("value")).agg(F.count("*").alias("n"))
    placed = values.select("n", F.explode(places(F.col("value"), depth, width)).alias("p"))
    return placed.groupBy("p.row", "p.pos").agg(F.least(F.sum("n"), F.lit(SATURATED)).alias("cnt"))


def merge(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("row", "pos").agg(F.least(F.sum("cnt"), F.lit(SATURATED)).alias("cnt"))


def estimates(items: DataFrame, column: str, counted: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """column, estimate: the least counter of each different item; never below its true count unless saturated."""
    values = items.filter(F.col(f"`{column}`").isNotNull()).select(column).distinct()
    asked = values.select(column, F.explode(places(canonical(items, column), depth, width)).alias("p")).select(column, "p.row", "p.pos")
    return asked.join(counted, ["row", "pos"], "left").groupBy(column).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def max_frequency(counted: DataFrame) -> DataFrame:
    """bound: no value is more frequent; null if a counter is saturated (saturated says so)."""
    top = F.max("cnt")
    return counted.agg(F.when(top < SATURATED, top).alias("bound"), F.coalesce(top >= SATURATED, F.lit(False)).alias("saturated"))


@dataclass
class CountMin:
    depth: int
    width: int
    counters: list[int]
    total: int

    def __post_init__(self):
        if self.depth < 1 or self.width < 1 or len(self.counters) != self.depth * self.width:
            raise ValueError("counters do not fill the rows")

    @classmethod
    def collect(cls, counted: DataFrame, total: int, depth: int = DEPTH, width: int = WIDTH) -> CountMin:
        """From at most depth * width rows."""
        out = [0] * (depth * width)
        for r in counted.collect():
            out[r["row"] * width + r["pos"]] = r["cnt"]
        return cls(depth, width, out, total)

    def estimate(self, value: bytes) -> int:
        import xxhash

        return min(self.counters[r * self.width + xxhash.xxh64_intdigest(value, SEED ^ r) % self.width] for r in range(self.depth))

    def is_saturated(self) -> bool:
        return SATURATED in self.counters

    def max_frequency_bound(self) -> int | None:
        return None if self.is_saturated() else max(self.counters)

    def merge(self, other: CountMin) -> CountMin:
        if (self.depth, self.width) != (other.depth, other.width):
            raise ValueError("sketches of different size")
        return CountMin(self.depth, self.width, [min(a + b, SATURATED) for a, b in zip(self.counters, other.counters, strict=True)], self.total + other.total)

    def to_bytes(self) -> bytes:
        n = len(self.counters)
        return struct.pack("<IIQ", self.depth, self.width, n) + struct.pack(f"<{n}I", *self.counters) + struct.pack("<Q", self.total)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountMin:
        if len(data) < 24:
            raise ValueError("too short for counters")
        depth, width, n = struct.unpack_from("<IIQ", data)
        if n != depth * width or len(data) != 24 + 4 * n:
            raise ValueError("counters do not fill the payload")
        return cls(depth, width, list(struct.unpack_from(f"<{n}I", data, 16)), struct.unpack_from("<Q", data, 16 + 4 * n)[0])

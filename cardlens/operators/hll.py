"""HyperLogLog: registers by a grouped maximum, estimate and sound floor."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.hashing import canonical, xxh64

SEED = 0
MIN_PRECISION, MAX_PRECISION = 4, 18


def check_precision(p: int) -> int:
    if not MIN_PRECISION <= p <= MAX_PRECISION:
        raise ValueError(f"precision {p} is not in {MIN_PRECISION}..{MAX_PRECISION}")
    return p


def register_columns(value: Column, p: int) -> tuple[Column, Column]:
    """(idx, rho): the top p bits of the hash, and the place of the first set bit in the others."""
    h = xxh64(value, SEED)
    rest = F.shiftleft(h, p)
    rho = F.when(rest == 0, F.lit(64 - p + 1)).otherwise(F.lit(65) - F.length(F.bin(rest)))
    return F.shiftrightunsigned(h, 64 - p).cast("int"), rho.cast("int")


def registers(df: DataFrame, column: str, p: int = 12, by: list[str] | None = None) -> DataFrame:
    """by..., idx, rho: the non-zero registers of the column, nulls left out. Maxima are combined before the shuffle."""
    idx, rho = register_columns(canonical(df, column), check_precision(p))
    rows = df.filter(F.col(f"`{column}`").isNotNull()).select(*(by or []), idx.alias("idx"), rho.alias("rho"))
    return rows.groupBy(*(by or []), "idx").agg(F.max("rho").alias("rho"))


def merge(*parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Registers of the union: the maximum of each."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*(by or []), "idx").agg(F.max("rho").alias("rho"))


def alpha(m: int) -> float:
    #: Bias corrections fixed by the algorithm for 16, 32 and 64 registers.
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def estimate(regs: DataFrame, p: int, by: list[str] | None = None) -> DataFrame:
    """by..., estimate, floor: the estimated count, cut to a whole number, and the number of non-zero registers.

    The floor never exceeds the true number of distinct values, so it is the one to derive bounds from.
    """
    m = 1 << check_precision(p)
    used, inverse = F.count("*"), F.sum(F.pow(F.lit(2.0), -F.col("rho")))
    sums = regs.groupBy(*(by or [])).agg(used.alias("floor"), F.coalesce(inverse, F.lit(0.0)).alias("inverse"))
    zeros = F.lit(m) - F.col("floor")
    raw = F.lit(alpha(m) * m * m) / (F.col("inverse") + zeros)
    few = (raw <= 2.5 * m) & (zeros > 0)
    return sums.select(*(by or []), F.floor(F.when(few, F.lit(float(m)) * F.log(F.lit(float(m)) / zeros)).otherwise(raw)).cast("long").alias("estimate"), "floor")


@dataclass
class HllSketch:
    """Registers held in the driver; p bits choose one of 2**p."""

    precision: int
    registers: bytes

    def __post_init__(self):
        check_precision(self.precision)
        if len(self.registers) != 1 << self.precision:
            raise ValueError(f"{len(self.registers)} registers for precision {self.precision}")
        if max(self.registers) > 65 - self.precision:
            raise ValueError("a register exceeds the bits of the hash")

    @classmethod
    def collect(cls, regs: DataFrame, p: int) -> HllSketch:
        """From at most 2**p register rows."""
        out = bytearray(1 << check_precision(p))
        for row in regs.select("idx", "rho").collect():
            out[row["idx"]] = row["rho"]
        return cls(p, bytes(out))

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, r) for i, r in enumerate(self.registers) if r], "idx int, rho int")

    def estimate(self) -> int:
        m = 1 << self.precision
        raw = alpha(m) * m * m / sum(2.0**-r for r in self.registers)
        zeros = self.registers.count(0)
        return int(m * math.log(m / zeros)) if raw <= 2.5 * m and zeros else int(raw)

    def distinct_floor(self) -> int:
        return len(self.registers) - self.registers.count(0)

    def merge(self, other: HllSketch) -> HllSketch:
        if self.precision != other.precision:
            raise ValueError("sketches of different precision")
        return HllSketch(self.precision, bytes(map(max, self.registers, other.registers)))

    def to_bytes(self) -> bytes:
        return struct.pack("<BQ", self.precision, len(self.registers)) + self.registers

    @classmethod
    def from_bytes(cls, data: bytes) -> HllSketch:
        if len(data) < 9:
            raise ValueError("too short for registers")
        p, n = struct.unpack_from("<BQ", data)
        if n != len(data) - 9:
            raise ValueError("registers do not fill the payload")
        return cls(p, data[9:])

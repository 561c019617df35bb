"""Histograms: equi-depth over one column, an equi-width grid over two."""

from __future__ import annotations

import math
import struct
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.functions.hashing import micros

from .ranks import RANGE_VALUES, ranked


def numeric(df: DataFrame, column: str):
    """The column as double; dates as days, timestamps as nanoseconds."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(c, kind).cast("double") * 1000
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise TypeError(f"column {column}: {kind.simpleString()} has no order of numbers")


def equi_depth(df: DataFrame, column: str, buckets: int, range_rows: int = RANGE_VALUES) -> DataFrame:
    """bucket (from 1), count, low (of the first: the minimum; else the last bucket's high), high.

    Ranks come from ranges of about equally many different values: no task sorts the whole column, and no value's copies
    are shuffled one by one.
    """
    if buckets < 2:
        raise ValueError("at least 2 buckets")
    v = numeric(df, column)
    found = ranked(df, F.when(~F.isnan(v), v), range_rows)
    b = F.least(F.lit(buckets), F.col("n"))
    size, extra = F.floor(F.col("n") / b), F.col("n") % b
    tile = lambda rank: F.when(rank <= extra * (size + 1), F.ceil(rank / (size + 1))).otherwise(extra + F.ceil((rank - extra * (size + 1)) / size)).cast("int")
    tiles = found.filter("n >= 2").select("v", "n", size.alias("size"), extra.alias("extra"), F.explode(F.sequence(tile(F.col("first")), tile(F.col("last")))).alias("bucket"))
    found = tiles.groupBy("bucket", "size", "extra").agg(F.max("v").alias("high"), F.min("v").alias("least"))
    step = Window.orderBy("bucket")
    return found.select("bucket", (F.col("size") + (F.col("bucket") <= F.col("extra")).cast("long")).alias("count"), F.coalesce(F.lag("high").over(step), F.col("least")).alias("low"), "high")


def range_estimate(histogram: DataFrame, lo: float, hi: float) -> DataFrame:
    """estimate: rows between lo and hi; whole buckets count, others by their overlap."""
    width = F.greatest(F.col("high") - F.col("low"), F.lit(sys.float_info.epsilon))
    whole = (F.col("low") >= lo) & (F.col("high") <= hi)
    overlap = F.least("high", F.lit(float(hi))) - F.greatest("low", F.lit(float(lo)))
    part = F.when(whole, F.col("count").cast("double")).when((F.col("high") < lo) | (F.col("low") > hi), 0.0).otherwise(F.col("count") * F.greatest(overlap, F.lit(0.0)) / width)
    return histogram.agg(F.floor(F.coalesce(F.sum(part), F.lit(0.0)) if lo <= hi else F.lit(0.0)).cast("long").alias("estimate"))


@dataclass
class EquiDepth:
    boundaries: list[float]
    counts: list[int]
    total: int | None = None

    def __post_init__(self):
        if self.total is None:
            self.total = sum(self.counts)
        b = self.boundaries
        if len(self.counts) < 2 or len(b) != len(self.counts) + 1 or any(map(math.isnan, b)) or any(x > y for x, y in zip(b, b[1:], strict=False)) or self.total != sum(self.counts):
            raise ValueError("not a histogram: two buckets, ascending boundaries and matching counts are needed")

    @classmethod
    def collect(cls, histogram: DataFrame) -> EquiDepth:
        """From one row for each bucket."""
        rows = sorted(histogram.collect(), key=lambda r: r["bucket"])
        if len(rows) < 2:
            raise ValueError("at least 2 values are needed")
        return cls([rows[0]["low"], *(r["high"] for r in rows)], [r["count"] for r in rows])

    def estimate_range(self, lo: float, hi: float) -> int:
        if lo > hi:
            return 0
        found = 0.0
        for low, high, n in zip(self.boundaries, self.boundaries[1:], self.counts, strict=False):
            if lo <= low and high <= hi:
                found += n
            elif high >= lo and low <= hi:
                found += n * max(0.0, min(high, hi) - max(low, lo)) / max(high - low, sys.float_info.epsilon)
        return int(found)

    def to_bytes(self) -> bytes:
        n, k = len(self.boundaries), len(self.counts)
        return struct.pack(f"<Q{n}dQ{k}QQ", n, *self.boundaries, k, *self.counts, self.total)

    @classmethod
    def from_bytes(cls, data: bytes) -> EquiDepth:
        try:
            (n,) = struct.unpack_from("<Q", data)
            if n > len(data) // 8:
                raise ValueError("boundaries do not fit the payload")
            boundaries = struct.unpack_from(f"<{n}d", data, 8)
            (k,) = struct.unpack_from("<Q", data, 8 + 8 * n)
            if len(data) != 8 * (n + k + 3):
                raise ValueError("buckets do not fill the payload")
            counts = struct.unpack_from(f"<{k}Q", data, 16 + 8 * n)
        except struct.error as e:
            raise ValueError(str(e)) from e
        return cls(list(boundaries), list(counts), struct.unpack_from("<Q", data, 16 + 8 * (n + k))[0])


def grid_layout(df: DataFrame, a: str, b: str) -> tuple[float, float, float, float] | None:
    """Finite minima and maxima of the pairs, or None if there are none."""
    x, y = numeric(df, a), numeric(df, b)
    finite = df.select(x.alias("x"), y.alias("y")).filter("abs(x) < double('infinity') AND abs(y) < double('infinity') AND NOT isnan(x) AND NOT isnan(y)")
    row = finite.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    return None if row["a"] is None else (row["a"], row["b"], row["c"], row["d"])


def _bin(v, lo: float, hi: float, n: int):
    return F.lit(0) if hi <= lo else F.least(F.greatest(F.floor((v - lo) / (hi - lo) * n), F.lit(0)), F.lit(n - 1)).cast("int")


def grid(df: DataFrame, a: str, b: str, bins_a: int, bins_b: int, layout: tuple[float, float, float, float]) -> DataFrame:
    """i, j, cnt: non-empty cells of the equi-width grid over finite pairs."""
    x, y = numeric(df, a), numeric(df, b)
    pairs = df.select(x.alias("x"), y.alias("y")).filter("abs(x) < double('infinity') AND abs(y) < double('infinity') AND NOT isnan(x) AND NOT isnan(y)")
    cells = pairs.select(_bin(F.col("x"), *layout[:2], bins_a).alias("i"), _bin(F.col("y"), *layout[2:], bins_b).alias("j"))
    return cells.groupBy("i", "j").agg(F.count("*").alias("cnt"))


def grid_merge(*parts: DataFrame) -> DataFrame:
    """Cells of grids of one layout, added up."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("i", "j").agg(F.sum("cnt").alias("cnt"))


@dataclass
class CorrelatedHistogram:
    bins_a: int
    bins_b: int
    layout: tuple[float, float, float, float]
    cells: list[int]

    def __post_init__(self):
        if self.bins_a < 1 or self.bins_b < 1 or len(self.cells) != self.bins_a * self.bins_b or any(map(math.isnan, self.layout)):
            raise ValueError("cells do not fill the grid")

    @property
    def total(self) -> int:
        return sum(self.cells)

    @classmethod
    def collect(cls, cells: DataFrame, bins_a: int, bins_b: int, layout) -> CorrelatedHistogram:
        """From at most bins_a * bins_b rows."""
        out = [0] * (bins_a * bins_b)
        for r in cells.collect():
            out[r["i"] * bins_b + r["j"]] = r["cnt"]
        return cls(bins_a, bins_b, tuple(layout), out)

    def estimate_range(self, a_lo: float, a_hi: float, b_lo: float, b_hi: float) -> int:
        """Sum of all cells that touch the rectangle: never less than the rows in it."""
        def touched(lo, hi, low, high, n):
            if lo > hi or hi < low or lo > high or not self.total:
                return range(0)
            place = lambda v: 0 if high <= low else min(n - 1, max(0, math.floor((min(max(v, low), high) - low) / (high - low) * n)))
            return range(place(lo), place(hi) + 1)

        return sum(self.cells[i * self.bins_b + j] for i in touched(a_lo, a_hi, *self.layout[:2], self.bins_a) for j in touched(b_lo, b_hi, *self.layout[2:], self.bins_b))

    def merge(self, other: CorrelatedHistogram) -> CorrelatedHistogram:
        if (self.bins_a, self.bins_b) != (other.bins_a, other.bins_b):
            raise ValueError("grids of different size")
        if not self.total or not other.total:
            return self if self.total else other
        if self.layout != other.layout:
            raise ValueError("grids of different layout")
        return CorrelatedHistogram(self.bins_a, self.bins_b, self.layout, [a + b for a, b in zip(self.cells, other.cells, strict=True)])

    def to_bytes(self) -> bytes:
        n = len(self.cells)
        return struct.pack(f"<II4dQ{n}QQ", self.bins_a, self.bins_b, *self.layout, n, *self.cells, self.total)

    @classmethod
    def from_bytes(cls, data: bytes) -> CorrelatedHistogram:
        if len(data) < 56:
            raise ValueError("too short for a grid")
        a, b, *layout, n = struct.unpack_from("<II4dQ", data)
        if n != a * b or len(data) != 56 + 8 * n:
            raise ValueError("cells do not fill the payload")
        out = cls(a, b, tuple(layout), list(struct.unpack_from(f"<{n}Q", data, 48)))
        if out.total != struct.unpack_from("<Q", data, 48 + 8 * n)[0]:
            raise ValueError("cells do not add up to the total")
        return out

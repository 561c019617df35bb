"""XXH64 with any seed as a Catalyst expression.

Spark's xxhash64 of several columns chains: the hash of one column is the seed of the next, beginning with 42. XXH64 of
one 8-byte value is a bijection for a fixed seed, so for each wanted seed there is a literal whose hash is that seed; put
before a column it sets the column's seed, within whole-stage code generation.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = 2**64
#: The five primes of XXH64, fixed by its definition.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_SPARK_SEED = 42


def _rotr(x: int, n: int) -> int:
    return (x >> n | x << (64 - n)) % _M


def _undo_shift(x: int, n: int) -> int:
    """The y with y ^ (y >> n) = x."""
    y = x
    for _ in range(64 // n + 1):
        y = x ^ (y >> n)
    return y


@lru_cache
def seed_literal(seed: int) -> int:
    """The signed 8-byte value whose XXH64 under Spark's own seed is seed."""
    inverse = lambda p: pow(p, -1, _M)
    h = _undo_shift(seed % _M, 32) * inverse(_P3) % _M
    h = _undo_shift(h, 29) * inverse(_P2) % _M
    h = _undo_shift(h, 33)
    h = _rotr((h - _P4) * inverse(_P1) % _M, 27) ^ ((_SPARK_SEED + _P5 + 8) % _M)
    value = _rotr(h * inverse(_P1) % _M, 31) * inverse(_P2) % _M
    return value - _M if value >= _M // 2 else value


def micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970; a timestamp without zone counts as UTC, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()) if isinstance(kind, T.TimestampNTZType) else c)


def canonical(df: DataFrame, name: str) -> Column:
    """The column in a type whose bytes Spark hashes as they are in Arrow: little-endian numbers, UTF-8 text, raw binary.

    Raises TypeError for types without a canonical encoding, instead of hashing something else.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.StringType, T.BinaryType, T.DateType)):
        return c
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit(bytearray(b"\x01"))).otherwise(F.lit(bytearray(b"\x00")))
    if isinstance(kind, T.ByteType):
        return F.unhex(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), -2, 2))
    if isinstance(kind, T.ShortType):
        text = F.lpad(F.hex(c.cast("long")), 16, "0")
        return F.unhex(F.concat(F.substring(text, -2, 2), F.substring(text, -4, 2)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(c, kind) * 1000
    raise TypeError(f"column {name}: {kind.simpleString()} has no canonical bytes")


def xxh64(column: Column, seed: int) -> Column:
    """XXH64(column, seed) as a signed long; null columns must be filtered before, as their hash is the seed."""
    return F.xxhash64(F.lit(seed_literal(seed)).cast("long"), column)


def unsigned_mod(h: Column, m: int) -> Column:
    """h mod m with h taken as unsigned, without overflow for m below 2**62."""
    return (F.shiftrightunsigned(h, 1) % F.lit(m) * 2 + h.bitwiseAND(F.lit(1))) % F.lit(m)

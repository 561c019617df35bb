"""SQL functions: hll_count(array) and the table function puffin_inspect(path)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cardlens.sources import puffin


def _bytes(value) -> bytes:
    """The bytes that a column of the value's type is hashed by."""
    import struct

    if isinstance(value, bool):
        return bytes([value])
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, float):
        return struct.pack("<d", value)
    return value.encode() if isinstance(value, str) else bytes(value)


def hll_count(values, p: int = 14) -> int:
    """Estimated number of different values, nulls left out."""
    import xxhash

    from cardlens.operators.hll import SEED, HllSketch

    registers = bytearray(1 << p)
    for v in values if values is not None else ():
        if v is not None and v == v:
            h = xxhash.xxh64_intdigest(_bytes(v), SEED)
            rest = (h << p) % 2**64
            i = h >> (64 - p)
            registers[i] = max(registers[i], 65 - p if not rest else 65 - rest.bit_length())
    return HllSketch(p, bytes(registers)).estimate()


class PuffinInspect:
    def eval(self, path: str):
        with open(path.removeprefix("file://"), "rb") as f:
            for i, blob in enumerate(puffin.inspect(f.read())["blobs"]):
                yield i, blob["type"], json.dumps(blob, sort_keys=True)


def install(spark: SparkSession) -> None:
    spark.udf.register("hll_count", F.pandas_udf(lambda s: pd.Series([hll_count(v) for v in s]), "long"))
    spark.udtf.register("puffin_inspect", F.udtf(PuffinInspect, returnType="blob int, kind string, entry string"))

"""Tables from Parquet and CSV folders, CSV columns, conversion, synthetic tables, sidecars of whole tables."""

from __future__ import annotations

import os
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import puffin

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder. Its schema is read once for each session; rows are read anew by every query."""
    known = spark.__dict__.setdefault("_cardlens_schemas", {})
    path = f"{folder}/{name}.parquet"
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return spark.read.schema(known[path]).parquet(path)


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Temporary views of the folder's Parquet tables; a missing one is an error."""
    found = {n: table(spark, folder, n) for n in names}
    for n, df in found.items():
        df.createOrReplaceTempView(n)
    return found


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Comma-separated, values may hold line ends, backslash escapes; the schema is declared, so no pass infers it."""
    return spark.read.csv(path, schema=schema, header=header, escape="\\", multiLine=True)


def csv_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Each declared table, from the folder's parquet subfolder where it has been converted, else from CSV."""
    out = {}
    for name, schema in schemas.items():
        converted = f"{folder}/parquet/{name}.parquet"
        out[name] = spark.read.parquet(converted) if os.path.exists(converted) else read_csv(spark, f"{folder}/{name}.csv", schema)
        out[name].createOrReplaceTempView(name)
    return out


def csv_to_parquet(spark: SparkSession, folder: str, schemas: dict[str, str]) -> None:
    for name, schema in schemas.items():
        read_csv(spark, f"{folder}/{name}.csv", schema).write.mode("overwrite").parquet(f"{folder}/parquet/{name}.parquet")


def csv_column(spark: SparkSession, path: str, index: int) -> DataFrame:
    """value: one column of a CSV file as text; an error where the file has no such column."""
    df = spark.read.csv(path)
    if not 0 <= index < len(df.columns):
        raise ValueError(f"{path} has {len(df.columns)} columns, not {index + 1}")
    return df.select(F.col(df.columns[index]).alias("value"))


def csv_numbers(spark: SparkSession, path: str, index: int) -> DataFrame:
    """value: the column as double, trimmed, blanks left out; text that is no number is an error when read."""
    text = F.trim("value")
    return csv_column(spark, path, index).filter(F.coalesce(text, F.lit("")) != "").select(F.coalesce(F.expr("try_cast(trim(value) AS double)"), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).alias("value"))


def synthetic(spark: SparkSession, scale: float = 1.0) -> dict[str, DataFrame]:
    """customers, products, orders and order_items from hashes of their row numbers; amounts over 3000 are delivered."""
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) / 1e6
    n = lambda rows: max(1, int(rows * scale))
    customers = spark.range(n(1000)).select(F.col("id").alias("customer_id"), pick(1, ["US", "EU", "APAC", "LATAM"]).alias("region"), pick(2, ["enterprise", "smb", "consumer"]).alias("segment"))
    products = spark.range(n(200)).select(F.col("id").alias("product_id"), pick(3, ["electronics", "apparel", "books", "home", "toys"]).alias("category"), (1 + unit(4) * 999).alias("price"))
    amount = F.round(10 + unit(5) * 4990, 2)
    orders = spark.range(n(10_000)).select(F.col("id").alias("order_id"), F.pmod(F.xxhash64("id", F.lit(6)), F.lit(n(1000))).alias("customer_id"), F.when(amount > 3000, "delivered").otherwise(pick(7, ["pending", "shipped", "cancelled", "returned"])).alias("status"), amount.alias("amount"))
    items = spark.range(n(30_000)).select(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(n(10_000))).alias("order_id"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(n(200))).alias("product_id"), (1 + F.pmod(F.xxhash64("id", F.lit(10)), F.lit(9))).alias("quantity"))
    return {"customers": customers, "products": products, "orders": orders, "order_items": items}


def build_sidecar(df: DataFrame, precision: int = 12, bloom_columns: tuple[str, ...] = (), bloom_capacity: int = 4_000_000, buckets: int = 0) -> bytes:
    """A sidecar with an HLL of every column that has canonical bytes, Blooms of the named ones, and the row count.

    All registers of all columns come from one pass: a row becomes one (column, idx, rho) for each column, maxima are
    combined before the shuffle, and at most columns * 2**precision rows reach the driver.
    """
    from cardlens.functions.hashing import canonical
    from cardlens.operators import bloom, histograms, hll

    writer = puffin.PuffinWriter().with_property(puffin.SCHEMA_VERSION_PROPERTY, puffin.SCHEMA_VERSION)
    marks, named = [], {}
    for i, name in enumerate(df.columns, 1):
        try:
            idx, rho = hll.register_columns(canonical(df, name), precision)
        except TypeError:
            continue
        named[i] = name
        marks.append(F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(i).alias("field"), idx.alias("idx"), rho.alias("rho"))))
    rows = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.field", "m.idx").agg(F.max("m.rho").alias("rho")).collect() if marks else []
    for i in named:
        registers = bytearray(1 << precision)
        for r in rows:
            if r["field"] == i:
                registers[r["idx"]] = r["rho"]
        writer.add_blob(puffin.HLL, [i], hll.HllSketch(precision, bytes(registers)).to_bytes())
        if named[i] in bloom_columns:
            bits, hashes = bloom.lossy_sizing(bloom_capacity, 0.01)
            writer.add_blob(puffin.BLOOM, [i], bloom.BloomFilter.collect(bloom.set_bits(df, named[i], bits, hashes), bits, hashes).to_bytes(), compress=True)
        if buckets:
            try:
                writer.add_blob(puffin.EQUI_DEPTH, [i], histograms.EquiDepth.collect(histograms.equi_depth(df, named[i], buckets)).to_bytes())
            except (TypeError, ValueError):
                pass
    return writer.add_blob(f"{puffin.PREFIX}.row-count-v1", [], struct.pack("<Q", df.count())).finish()


def sidecar_rows(data: bytes) -> int | None:
    reader = puffin.PuffinReader(data)
    return next((struct.unpack("<Q", reader.read(b))[0] for b in reader.blobs if b.kind == f"{puffin.PREFIX}.row-count-v1"), None)


def evict_page_cache(folder: str) -> int:
    """Asks the kernel to forget the folder's Parquet files; the number of files."""
    n = 0
    for p in Path(folder).rglob("*.parquet"):
        if p.is_file():
            fd = os.open(p, os.O_RDONLY)
            try:
                os.posix_fadvise(fd, 0, 0, os.POSIX_FADV_DONTNEED)
                n += 1
            finally:
                os.close(fd)
    return n

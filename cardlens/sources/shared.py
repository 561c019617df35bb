"""Files of stores on whatever file system Spark reaches: small texts and listings, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of what a folder holds; none if there is no folder."""
    fs, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Replaces the file."""
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, mode: str | None = None) -> None:
    """Replaces the file; mode as in "600"."""
    write_bytes(spark, path, text.encode())
    if mode:
        restrict(spark, path, mode)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def restrict(spark: SparkSession, path: str, mode: str) -> None:
    fs, where = _at(spark, path)
    fs.setPermission(where, spark._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))


def delete(spark: SparkSession, path: str) -> None:
    """A file or a folder with all that it holds."""
    fs, where = _at(spark, path)
    fs.delete(where, True)

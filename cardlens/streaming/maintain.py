"""Mergeable sketches over a stream: each micro-batch's registers are merged into the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cardlens.operators import cms, hll
from cardlens.sources import shared


def _versions(spark, path: str) -> list[int]:
    """Whole ones, on any file system."""
    return sorted(int(n) for n in shared.names(spark, path) if n.isdigit() and shared.exists(spark, f"{path}/{n}/_SUCCESS"))


def _merge_into(path: str, batch_id: int, rows: DataFrame, merge) -> None:
    """Writes the next version under the batch's number: a batch that is run again replaces its own version only."""
    older = [v for v in _versions(rows.sparkSession, path) if v < batch_id]
    if older:
        rows = merge(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{older[-1]}"), rows)
    rows.write.mode("overwrite").parquet(f"{path}/{batch_id}")


def hll_stream(stream: DataFrame, column: str, path: str, checkpoint: str, p: int = 12):
    """A writer that keeps the column's registers under path."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: _merge_into(path, i, hll.registers(df, column, p), hll.merge))


def count_min_stream(stream: DataFrame, column: str, path: str, checkpoint: str, depth: int = cms.DEPTH, width: int = cms.WIDTH):
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: _merge_into(path, i, cms.counters(df, column, depth, width), cms.merge))


def latest(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")

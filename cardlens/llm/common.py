"""What the corpus operators share: the shared folder, written intermediate tables, components of a graph."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; the same class everywhere.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of one row per source, class or the like is broadcast.
BROADCAST_ROWS = 100_000
#: Rows in a batch that goes to a Python worker: bounds its memory where texts are long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cardlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: str | DataFrame) -> None:
    """Deletes written tables that nothing reads any more: paths, or what written() gave."""
    for table in tables:
        for path in [table] if isinstance(table, str) else {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its counted rows stay under the bound, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_prefix(df: DataFrame) -> str:
    """What none of df's column names begins with, for columns that an operator adds for a while."""
    prefix = "_op_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def python_batches(spark: SparkSession) -> None:
    """Bounds the rows of a batch for Python workers, as single texts may be very long, and gives them this package if their path lacks it."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(package.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(context, "_cardlens_sent", False):
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
        context._cardlens_sent = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def row_id(doc_id: str = "doc_id", text: str = "text"):
    """doc_id, or where it is null a number of 2**62 and more drawn from the text."""
    return F.coalesce(F.col(doc_id), F.lit(2**62) + F.pmod(F.xxhash64(F.col(text)), F.lit(2**62)))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the smallest node that it reaches.

    Large-star and small-star rounds: each only takes minima by node, which are combined before the shuffle, and joins
    them back to edges, where Spark splits a node of very many edges. A round is written to the shared folder.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(star.select("e.u", "e.v").filter("u <> v").distinct(), "small")
        discard(edges.sparkSession, last, large)
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

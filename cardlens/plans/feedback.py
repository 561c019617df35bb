"""Feedback: an append-only Parquet store of estimates and actual rows, q-errors and reports."""

from __future__ import annotations

import json
import math
import secrets
import time
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.operators.ranks import ranked
from cardlens.sources import shared

from .capture import FEATURES, CorrectionFeatures

VERSION = 2
SCHEMA = "id long, template_hash string, plan_fingerprint string, est_rows long, actual_rows long, latency_ms double, recorded_at double, " + ", ".join(f"{n} double" for n in FEATURES)


def q_error(estimate: float, actual: float) -> float:
    """Infinite if one of them is 0."""
    return math.inf if not estimate or not actual else max(estimate / actual, actual / estimate)


def q_error_floored(estimate: float, actual: float) -> float:
    """Both taken as 1 at least, so always finite."""
    e, a = max(1.0, estimate), max(1.0, actual)
    return max(e / a, a / e)


def q_error_column(estimate: str = "est_rows", actual: str = "actual_rows"):
    """Null stands for infinite."""
    e, a = F.col(estimate).cast("double"), F.col(actual).cast("double")
    return F.when((e != 0) & (a != 0), F.greatest(e / a, a / e))


def q_error_floored_column(estimate: str = "est_rows", actual: str = "actual_rows"):
    e, a = (F.greatest(F.lit(1.0), F.col(c).cast("double")) for c in (estimate, actual))
    return F.greatest(e / a, a / e)


@dataclass(frozen=True)
class Observation:
    template_hash: str
    plan_fingerprint: str
    est_rows: int
    actual_rows: int
    latency_ms: float | None = None
    features: CorrectionFeatures | None = None


class FeedbackStore:
    """A folder of Parquet files and a version file on any file system of Spark's; a newer version is refused, older rows lack features.

    Several writers may append at once: an id is the microsecond of its record with 11 random bits, ascending in time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = f"{self.path}/_meta.json"
        if shared.exists(spark, meta):
            if (found := json.loads(shared.read_text(spark, meta))["version"]) > VERSION:
                raise ValueError(f"the store has version {found}; this library knows {VERSION}")
        else:
            shared.make_folder(spark, self.path)
            shared.restrict(spark, self.path, "700")
        shared.write_text(spark, meta, json.dumps({"version": VERSION}), "600")

    def record(self, *observations: Observation) -> list[int]:
        """Appends in one job; the new ids."""
        now = time.time()
        start = int(now * 1e6) * 2**11 + secrets.randbits(11)
        rows = [(start + 2**11 * i, o.template_hash, o.plan_fingerprint, o.est_rows, o.actual_rows, o.latency_ms, now, *([float(x) for x in astuple(o.features)] if o.features else [None] * len(FEATURES))) for i, o in enumerate(observations)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/rows")
        return [r[0] for r in rows]

    def all(self) -> DataFrame:
        if not shared.exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows")

    def history(self, template: str) -> DataFrame:
        return self.all().filter(F.col("template_hash") == template).orderBy("id")

    def plan_history(self, template: str) -> DataFrame:
        """Rows with features only."""
        return self.history(template).filter("predicate_count IS NOT NULL")

    def count(self) -> int:
        return self.all().count()

    def templates(self) -> DataFrame:
        """template_hash, n, avg_q (finite ones over all), max_q, n_infinite."""
        return template_report(self.all())

    def latencies(self) -> DataFrame:
        return latency_percentiles(self.all())


def template_report(rows: DataFrame) -> DataFrame:
    q = rows.withColumn("q", q_error_column())
    return q.groupBy("template_hash").agg(F.count("*").alias("n"), (F.coalesce(F.sum("q"), F.lit(0.0)) / F.count("*")).alias("avg_q"), F.max("q").alias("max_q"), F.sum(F.col("q").isNull().cast("long")).alias("n_infinite"))


def latency_percentiles(rows: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """One row: p50, p90, ... by nearest rank round(share * (n - 1)); equal latencies are ranked as one."""
    found = ranked(rows, F.col("latency_ms"))
    return found.agg(*[F.min(F.when(F.col("last") > F.floor(F.lit(s) * (F.col("n") - 1) + 0.5), F.col("v"))).alias(f"p{s * 100:g}") for s in shares])


def summary(q_errors: DataFrame, q: str = "q") -> DataFrame:
    """geomean and max of the finite q-errors, and how many were not."""
    return q_errors.agg(F.exp(F.avg(F.log(q))).alias("geomean"), F.max(q).alias("max"), F.sum(F.col(q).isNull().cast("long")).alias("n_infinite"))


def rote_recall(rows: DataFrame) -> DataFrame:
    """The last actual rows of each plan."""
    return rows.groupBy("plan_fingerprint").agg(F.max_by("actual_rows", "id").alias("recalled"))


def run_with_feedback(df: DataFrame, store: FeedbackStore, template: str) -> DataFrame:
    """Runs df, records its rows and time with no estimate, and gives it back."""
    began = time.perf_counter()
    rows = df.count()
    store.record(Observation(template, "", 0, rows, (time.perf_counter() - began) * 1000))
    return df


def capture(df: DataFrame, store: FeedbackStore, template: str) -> Observation:
    """Runs df and records estimate, actual rows, time and features."""
    from .capture import logical, observe

    out = observe(df)
    import hashlib

    mark = hashlib.sha256(repr([n.name for n in logical(df).walk()]).encode()).hexdigest()[:16]
    seen = Observation(template, mark, out.estimate, out.actual, out.seconds * 1000, out.features)
    store.record(seen)
    return seen

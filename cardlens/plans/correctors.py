"""Correctors: from a plan's features to a better estimate, or None to abstain."""

from __future__ import annotations

import json
import math
import os
import warnings
from typing import Protocol
from urllib.parse import urlparse
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.operators.bounds import LIMIT, saturating_clamp

from .capture import FEATURES, CorrectionFeatures


class Corrector(Protocol):
    name: str

    def correct(self, features: CorrectionFeatures) -> int | None: ...


class Identity:
    name = "identity"

    def correct(self, features: CorrectionFeatures) -> int | None:
        return int(features.baseline)


class Disabled:
    name = "disabled"

    def correct(self, features: CorrectionFeatures) -> int | None:
        return None


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(df)


class GradientBoosted:
    """MLlib's boosted trees over the features.

    multiplicative learns ln(actual / estimate) from rows without zeros; additive learns the actual rows. Predictions are
    clamped to the ceiling. score() corrects a whole DataFrame in one pass.
    """

    ROWS_OF_A_TASK = 100_000

    def __init__(self, model, additive: bool = False, ceiling: int = LIMIT, training_rows: int = 0):
        self.model, self.additive, self.ceiling, self.training_rows = model, additive, ceiling, training_rows
        self.name = "gbt-additive" if additive else "gbt"

    @classmethod
    def fit(cls, rows: DataFrame, additive: bool = False, ceiling: int = LIMIT, trees: int = 50, depth: int = 4, rate: float = 0.1) -> GradientBoosted:
        """rows: est_rows, actual_rows and, where known, the features; missing ones are 0, the baseline the estimate."""
        from pyspark.ml.regression import GBTRegressor

        given = rows.withColumns({"baseline": F.col("est_rows").cast("double")} | {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in FEATURES[1:]})
        if additive:
            known = given.withColumn("label", F.col("actual_rows").cast("double"))
        else:
            known = given.filter("est_rows > 0 AND actual_rows > 0").withColumn("label", F.log(F.col("actual_rows") / F.col("est_rows")))
        known = _vector(known).select("features", "label").persist()
        try:
            n = known.count()
            if not n:
                raise ValueError("no rows to learn from")
            few = known.coalesce(-(-n // cls.ROWS_OF_A_TASK))  # each of the many small jobs has a task for each partition
            return cls(GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=1, seed=1).fit(few), additive, ceiling, n)
        finally:
            known.unpersist()

    def correct(self, features: CorrectionFeatures) -> int | None:
        from pyspark.ml.linalg import Vectors

        p = self.model.predict(Vectors.dense(features.to_list()))
        return saturating_clamp(p if self.additive else features.baseline * math.exp(min(p, 700)), self.ceiling)

    def score(self, df: DataFrame) -> DataFrame:
        """df, which has the features, with the column corrected."""
        p = F.col("prediction") if self.additive else F.col("baseline") * F.exp(F.least("prediction", F.lit(700.0)))
        out = self.model.transform(_vector(df)).withColumn("corrected", F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(float(min(self.ceiling, 2**62))))).cast("long"))
        return out.drop("features", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, additive: bool = False, ceiling: int = LIMIT) -> GradientBoosted:
        from pyspark.ml.regression import GBTRegressionModel

        return cls(GBTRegressionModel.load(path), additive, ceiling)


class Http:
    """Posts features and baseline to a server that answers {"estimate": n}; any failure abstains."""

    def __init__(self, url: str, timeout: float = 0.05, ceiling: int = LIMIT, name: str = "http"):
        self.url, self.timeout, self.ceiling, self.name = url, min(timeout, 60.0), ceiling, name
        where = urlparse(url)
        if where.scheme == "http" and where.hostname not in ("localhost", "127.0.0.1", "::1") and not os.environ.get("CARDLENS_ALLOW_PLAIN_HTTP"):
            warnings.warn(f"{where.hostname} is asked over plain http", stacklevel=2)

    def correct(self, features: CorrectionFeatures) -> int | None:
        body = json.dumps({"features": features.to_list(), "baseline_estimate": int(features.baseline)}).encode()
        try:
            with urlopen(Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
                n = json.loads(answer.read(65536))["estimate"]
            return saturating_clamp(n, self.ceiling) if isinstance(n, (int, float)) and n >= 0 else None
        except (OSError, ValueError, KeyError, TypeError):
            return None


def language_model(url: str, timeout: float = 2.0, ceiling: int = LIMIT) -> Http:
    """The same exchange with a slower server."""
    return Http(url, timeout, ceiling, "language-model")


def ablation_features(rows: DataFrame) -> DataFrame:
    """A second feature set: baseline, least table, skew of the distinct counts, log10 of the ceiling, mean log residual by template."""
    residual = F.when((F.col("est_rows") > 0) & (F.col("actual_rows") > 0), F.log(F.col("actual_rows") / F.col("est_rows")))
    means = rows.groupBy("template_hash").agg(F.avg(residual).alias("mean_log_residual"))
    d = (F.greatest(F.col("left_distinct"), F.lit(1.0)), F.greatest(F.col("right_distinct"), F.lit(1.0)))
    return rows.join(means, "template_hash").select("id", "baseline", F.least("left_rows", "right_rows").alias("min_rows"), (F.greatest(*d) / F.least(*d)).alias("distinct_skew"), F.log10(F.greatest(F.col("left_rows") * F.col("right_rows"), F.lit(1.0))).alias("log_ceiling"), F.coalesce("mean_log_residual", F.lit(0.0)).alias("mean_log_residual"))

"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades are ordered and come from the labels alone: 0 for clean rows, 1 for toxic ones, 2 for toxic ones of good
quality, which no quality filter would drop; or any whole numbers from 0 in a column of the caller's. The model shares one weight for each feature across the
thresholds between grades: P(grade > k) = sigmoid(w.x - threshold[k]), thresholds ascending. The features are the words and
beginnings of words of the vocabulary that a text has, as 1, and nothing for the others. The expected severity is the
sum of P(grade > k) over the thresholds; a text is toxic if P(grade > 0) is at least one half.

Training takes at most about SAMPLE_ROWS labelled rows, drawn by a hash of doc_id, half of them graded above 0 where there
are as many. Their whole texts become features in Spark, where the rows of each kind that have a feature are counted;
the driver gets those features that tell the kinds apart (LEAST_G2), all of them, and the sampled rows as places among them.

Defined cases: a null text, or one without words, has the severity of no features; labels without a document, null labels
and null doc_ids teach nothing, a null quality is not good; of several labels of a doc_id the highest grade teaches, of
several texts one drawn by its hash; without labels of both kinds every severity is 0; repeated rows are rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_batches, written

SAMPLE_ROWS = 6_000
#: A word is a feature if its rows differ so much from chance between toxic and clean rows (log-likelihood ratio G2): words
#: that are in a few toxic rows by chance would add up in long texts.
LEAST_G2 = 16.0
PREFIXES = (4, 5)
_LETTERS = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters."""
    return (text or "").lower().encode().translate(_LETTERS).split()


def features(found: list[bytes]) -> set[bytes]:
    """The words, and the first bytes of longer ones, which inflected and compound forms share."""
    different = set(found)
    return different.union(*([w[:n] + b"*" for w in different if len(w) > n] for n in PREFIXES))


def default_grade() -> Column:
    """From the columns toxic and quality of labels."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 1, 2).otherwise(1))


def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([[f.decode("latin-1") for f in sorted(features(words(t)))] for t in texts])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, float] | None:
    """grade and the features of a bounded, hashed sample of the labelled rows, written, and the log of how much likelier rows above grade 0 were to be drawn."""
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("grade") >= 0)).groupBy(F.col("doc_id").alias("id")).agg(F.max("grade").cast("int").alias("grade"))
    kinds = {r["kind"]: r["n"] for r in known.groupBy((F.col("grade") > 0).alias("kind")).agg(F.count("*").alias("n")).collect()}
    if set(kinds) != {False, True}:
        return None
    drawn_share = [min(1.0, rows / 2 / kinds[kind]) for kind in (False, True)]
    share = F.when(F.col("grade") > 0, drawn_share[1]).otherwise(drawn_share[0])
    drawn = F.broadcast(known.filter(F.pmod(F.xxhash64("id"), F.lit(2**20)) < share * 2**20))  # about `rows` rows
    texts = docs.join(drawn, F.col("doc_id") == F.col("id")).select("doc_id", "grade", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one for each label, however often its doc_id is there
    found = texts.select("doc_id", "grade", F.pandas_udf(_features, "array<string>")("text").alias("features"))
    return written(found, "toxicity-sample"), float(np.log(drawn_share[1] / drawn_share[0]))


def vocabulary(found: DataFrame) -> list[str]:
    """The features whose rows differ between the two kinds by more than chance (G2 of LEAST_G2 or more)."""
    kind = F.col("grade") > 0
    n1, n0 = found.agg(F.count_if(kind), F.count_if(~kind)).first()
    if not n1 or not n0:
        return []
    counts = found.select(kind.alias("kind"), F.explode("features").alias("f")).groupBy("f").agg(F.count_if("kind").cast("double").alias("c1"), F.count_if(~F.col("kind")).cast("double").alias("c0"))
    n, has = float(n0 + n1), F.col("c0") + F.col("c1")
    term = lambda cell, margin, total: cell * F.log(F.greatest(cell, F.lit(1e-9)) / F.greatest(margin * (total / n), F.lit(1e-9)))
    parts = [term(F.col(c), has, t) + term(t - F.col(c), n - has, t) for c, t in (("c0", float(n0)), ("c1", float(n1)))]
    return [r["f"] for r in counts.filter(2 * (parts[0] + parts[1]) >= LEAST_G2).select("f").orderBy("f").collect()]


def training_rows(found: DataFrame, vocabulary: list[str]) -> list[tuple[int, np.ndarray]]:
    """grade and places in vocabulary of each sampled row."""
    place = {f: i for i, f in enumerate(vocabulary)}

    def places(rows: pd.Series) -> pd.Series:
        return pd.Series([[place[f] for f in r if f in place] for r in rows])

    rows = found.select("doc_id", "grade", F.pandas_udf(places, "array<int>")("features").alias("at")).collect()
    return [(r["grade"], np.array(sorted(r["at"]), np.int64)) for r in sorted(rows, key=lambda r: r["doc_id"])]


class CumulativeLink:
    """Weights shared by ordered thresholds."""

    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, texts) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        get = self.weights.get
        x = np.array([sum(map(get, features(words(t)), repeat(0.0))) for t in texts], np.float64)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -500, 500)))


def fit(rows: list[tuple[int, np.ndarray]], vocabulary: list[str], shift: float = 0.0, epochs: int = 25, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> CumulativeLink | None:
    """Adagrad on the likelihood of all thresholds, weights drawn to zero; None without rows of both kinds. shift undoes the sample's odds."""
    y = np.array([grade for grade, _ in rows])
    if not rows or not y.max() or y.min():
        return None
    sets, above = [at for _, at in rows], int(y.max())
    w, wg = np.zeros(len(vocabulary)), np.full(len(vocabulary), 1e-8)
    gap, gg = np.full(above, 0.5), np.full(above, 1e-8)  # thresholds: the first, then log distances
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), 32):
            lot = order[i : i + 32]
            at = np.concatenate([sets[j] for j in lot])
            row = np.repeat(np.arange(len(lot)), [len(sets[j]) for j in lot])
            x = np.bincount(row, w[at], len(lot)).astype(float)
            steps = np.exp(gap[1:])
            thresholds = gap[0] + np.r_[0, np.cumsum(steps)]
            p = 1 / (1 + np.exp(np.clip(thresholds - x[:, None], -30, 30)))
            d = (p - (y[lot][:, None] > np.arange(above))) / len(lot)  # of x; of a threshold it is -d
            g = np.bincount(at, d.sum(axis=1)[row], len(w)).astype(float)
            used = np.unique(at)
            g[used] += decay * w[used]
            wg[used] += g[used] ** 2
            w[used] -= rate * g[used] / np.sqrt(wg[used])
            w[used] = np.sign(w[used]) * np.maximum(np.abs(w[used]) - decay, 0)
            t = -d.sum(axis=0)
            down = t[::-1].cumsum()[::-1]
            step = np.r_[down[0], down[1:] * steps]
            gg += step**2
            gap -= rate * step / np.sqrt(gg)
    thresholds = gap[0] + np.r_[0, np.cumsum(np.exp(gap[1:]))] + shift
    return CumulativeLink({f.encode("latin-1"): float(w[i]) for i, f in enumerate(vocabulary) if w[i]}, thresholds)


def _scorer(model: CumulativeLink | None):
    def score(texts: pd.Series) -> pd.DataFrame:
        above = model.above(texts) if model else np.zeros((len(texts), 1))
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(axis=1).astype(np.int32), "toxic": above[:, 0] >= 0.5})

    return F.pandas_udf(score, "severity double, p_toxic double, grade int, toxic boolean")


def taught(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> CumulativeLink | None:
    """The model that labels (doc_id, grade) teach."""
    drawn = sample(docs, labels, rows)
    if drawn is None:
        return None
    found, shift = drawn
    chosen = vocabulary(found)
    return fit(training_rows(found, chosen), chosen, shift)


def severities(docs: DataFrame, labels: DataFrame, grade: Column | None = None) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade, toxic for each row of docs; grade is a column of labels."""
    python_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model = taught(docs, labels.select("doc_id", (default_grade() if grade is None else grade).alias("grade")))
    return docs.select("doc_id", _scorer(model)(F.col("text")).alias("s")).select("doc_id", "s.severity", "s.p_toxic", "s.grade", "s.toxic")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return severities(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

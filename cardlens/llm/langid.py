"""Language identification by a convolutional network over bytes, trained in numpy.

A text is lower-cased and its UTF-8 bytes are cut into windows of WINDOW bytes, the last filled up with zeros. Each byte
is embedded; filters of several widths slide over the window, their greatest responses go through a softmax. A text's
language is the one of the greatest probability, averaged over all its windows by their bytes.

Training sees WINDOWS_PER_CLASS (expected) windows of each language, drawn alike from all windows of all whole texts that
may teach: a sample bounded whatever the size of the table. It is drawn by a hash, and training is seeded: reruns agree.

Defined cases: null text, or text without a letter, is und with score 0; without labelled rows every text is und; rows of
a null doc_id are not held out; a null language teaches nothing; an empty table gives an empty table; other columns are
ignored, and kept by known_languages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, python_batches

WINDOW = 192
#: Labelled windows that training sees, for each language.
WINDOWS_PER_CLASS = 2_000
#: Widths of 4 at most, as responses are looked up by two pairs of bytes.
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 6
UNKNOWN = "und"
#: Texts whose language is less certain than this are rejected by known_languages.
LEAST_SCORE = 0.3


class ByteNetwork:
    """Embedding, filters of several widths, greatest response, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))), "bias": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"filters{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["embedding"][0] = 0

    def _responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all filters at each byte, a filter's last bytes lying beyond the window being zero: (rows, places, filters); and what they saw."""
        places, widest = x.shape[1], max(WIDTHS)
        e = self.p["embedding"][np.pad(x, ((0, 0), (0, widest - 1)))]
        seen = np.concatenate([e[:, j : j + places] for j in range(widest)], axis=2)
        filters = np.zeros((widest * EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
        for n, w in enumerate(WIDTHS):
            filters[: w * EMBEDDING, n * FILTERS : (n + 1) * FILTERS] = self.p[f"filters{w}"]
        return (seen.reshape(-1, seen.shape[2]) @ filters).reshape(len(x), places, -1), seen

    def _pool(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + np.concatenate([self.p[f"bias{w}"] for w in WIDTHS]), 0)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What all filters respond to any pair of bytes, as their first and as their third and fourth bytes."""
        out = []
        for start in (0, 2):
            table = np.zeros((65536, len(WIDTHS) * FILTERS), np.float32)
            for j in (start, start + 1):
                k = np.zeros((EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
                for n, w in enumerate(WIDTHS):
                    if j < w:
                        k[:, n * FILTERS : (n + 1) * FILTERS] = self.p[f"filters{w}"][j * EMBEDDING : (j + 1) * EMBEDDING]
                one = self.p["embedding"] @ k
                table += np.repeat(one, 256, axis=0) if j == start else np.tile(one, (256, 1))
            out.append(table)
        return out[0], out[1]

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None, lot: int = 32) -> np.ndarray:
        """The softmax for each window; responses are looked up by pairs of bytes, which is the same sum."""
        first, second = tables or self.tables()
        out = [np.zeros((0, len(self.classes)), np.float32)]
        for i in range(0, len(x), lot):
            w = np.pad(x[i : i + lot], ((0, 0), (0, 3))).astype(np.uint16)
            pairs = (w[:, :-1] << 8) | w[:, 1:]
            top = np.take(first, pairs[:, :WINDOW], axis=0)
            top += np.take(second, pairs[:, 2:], axis=0)
            while (n := top.shape[1]) > 1:
                top = np.maximum(top[:, : -(-n // 2)], top[:, n // 2 :])
            out.append(self._softmax(self._pool(top[:, 0])))
        return np.concatenate(out)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        responses, seen = self._responses(x)
        best = responses.argmax(axis=1)
        pooled = self._pool(np.take_along_axis(responses, best[:, None, :], axis=1)[:, 0])
        d = self._softmax(pooled)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": pooled.T @ d, "bias": d.sum(axis=0), "embedding": np.zeros_like(self.p["embedding"])}
        back = (d @ self.p["out"].T) * (pooled > 0)
        rows = np.arange(len(x))[:, None]
        x = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        for n, w in enumerate(WIDTHS):
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            b, at = back[:, own], best[:, own]
            g[f"filters{w}"] = np.einsum("rf,rfc->cf", b, seen[rows, at, : w * EMBEDDING])  # where each filter responded most
            g[f"bias{w}"] = b.sum(axis=0)
            to_bytes = (b[:, :, None] * self.p[f"filters{w}"].T).reshape(len(x), FILTERS, w, EMBEDDING)
            for j in range(w):
                np.add.at(g["embedding"], x[rows, at + j], to_bytes[:, :, j])
        g["embedding"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, lot: int = 64, rate: float = 4e-3, seed: int = 11) -> ByteNetwork:
        """Adam over shuffled lots."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), lot):
                t += 1
                for k, g in self._gradients(x[order[i : i + lot]], y[order[i : i + lot]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(text: str) -> np.ndarray:
    """All bytes of the lower-cased text in rows of WINDOW, at least one row."""
    data = text.lower().encode().replace(b"\0", b" ")
    out = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), np.uint8)
    out.ravel()[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, windows_per_class: int = WINDOWS_PER_CLASS) -> list:
    """(lang, piece of text) of a bounded sample of the windows of all rows that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = F.greatest(F.ceil(F.length("text") / WINDOW), F.lit(1)).cast("long")
    counts = known.groupBy("lang").agg(F.sum(n).alias("n")).select(F.col("lang").alias("of"), F.least(F.lit(1.0), windows_per_class / F.col("n")).alias("share"))
    drawn = known.join(F.broadcast(counts), F.col("lang") == F.col("of")).select("doc_id", "lang", "text", "share", F.xxhash64("doc_id", "text").alias("h"), n.alias("n"))  # a row for each class of the softmax
    places = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.pmod(F.xxhash64(F.col("h"), i), F.lit(2**30)) < F.col("share") * 2**30)
    pieces = drawn.select("doc_id", "h", "lang", "text", F.explode(places).alias("i")).select("doc_id", "h", "lang", "i", F.substring("text", (F.col("i") * WINDOW + 1).cast("int"), F.lit(WINDOW)).alias("piece"))
    found = pieces.dropDuplicates(["doc_id", "h", "lang", "i"]).collect()  # a row that is there many times is drawn as often
    return [(r["lang"], r["piece"]) for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["i"], r["doc_id"] or 0, r["piece"]))]


def train(pieces: list, seed: int = 3) -> ByteNetwork | None:
    """None if there is nothing to learn from. Some windows are cut short, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    pieces = [(lang, p) for lang, p in pieces if has_letter(p)]
    if not pieces:
        return None
    classes = sorted({lang for lang, _ in pieces})
    x = np.concatenate([windows(p)[:1] for _, p in pieces])
    for i in np.flatnonzero(rng.random(len(x)) < 0.3):
        x[i, rng.integers(8, WINDOW) :] = 0
    y = np.array([classes.index(lang) for lang, _ in pieces])
    return ByteNetwork(classes).fit(x, y)


def _predictor(model: ByteNetwork | None):
    tables = []

    def predict(texts: pd.Series) -> pd.DataFrame:
        if model and not tables:
            tables.append(model.tables())
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if model and has_letter(t)]
        lots: list[list[int]] = [[]]
        for i in at:  # of bounded bytes, as a lot is held in memory
            if sum(len(texts[j]) for j in lots[-1]) + len(texts[i]) > 2**21 and lots[-1]:
                lots.append([])
            lots[-1].append(i)
        for lot in filter(None, lots):
            x = [windows(texts[i]) for i in lot]
            start = np.cumsum([0, *map(len, x)])[:-1]
            x = np.concatenate(x)
            weight = (x > 0).sum(axis=1).astype(np.float64)
            p = np.add.reduceat(model.probabilities(x, tables[0]) * weight[:, None], start) / np.add.reduceat(weight, start)[:, None]
            lang[lot] = np.array(model.classes, object)[p.argmax(axis=1)]
            score[lot] = np.clip(p.max(axis=1), 0, 1)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(predict, "lang_pred string, score double")


def fitted(docs: DataFrame, windows_per_class: int = WINDOWS_PER_CLASS):
    """A function of the column text that gives the struct lang_pred, score."""
    python_batches(docs.sparkSession)
    return _predictor(train(training_windows(docs.select("doc_id", "text", "lang"), windows_per_class)))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    found = docs.select("doc_id", held_out().alias("held_out"), fitted(docs)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_languages(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is recognised, with the columns of docs."""
    name = free_prefix(docs) + "language"
    found = docs.withColumn(name, fitted(docs)(F.col("text")))
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))

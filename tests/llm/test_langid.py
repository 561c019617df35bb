import zlib

import numpy as np
from pyspark.sql import functions as F

from cardlens.llm import langid

from .util import empty_documents, odd_documents, save, with_clashes


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in langid.op7_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    held = [r for r in docs if out[r["doc_id"]]["held_out"] and r["lang"]]
    assert np.mean([out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    pieces = langid.training_windows(docs)
    held = {r["doc_id"] for r in docs.filter(langid.held_out()).collect()}
    assert held and not {int(p.split()[1]) for _, p in pieces if p.startswith("text ")} & held


def test_defined_cases(spark, tmp_path):
    docs = odd_documents(spark)
    out = langid.op7_language_id(spark, save(with_clashes(docs), tmp_path)).collect()
    assert len(out) == docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if r["doc_id"] in (3, 4, 6))
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in out)
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    kept = langid.known_languages(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns and kept.filter("text IS NULL").count() == 0
    assert langid.predictions(empty_documents(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lookup_by_pairs_equals_the_filters():
    model = langid.ByteNetwork(["a", "b"])
    x = langid.windows("The quick brown fox. " * 30)
    direct = model._softmax(model._pool(model._responses(x)[0].max(axis=1)))
    assert np.allclose(model.probabilities(x), direct, atol=1e-5)


def test_gradients_against_differences():
    model = langid.ByteNetwork(["a", "b", "c"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.concatenate([langid.windows("some text here"), langid.windows("other words")]), np.array([0, 2])

    def loss():
        p = model._softmax(model._pool(model._responses(x)[0].max(axis=1)))
        return -np.log(p[np.arange(2), y]).mean()

    grads = model._gradients(x, y)
    rng = np.random.default_rng(0)
    for name in ("out", "filters3", "bias2", "embedding"):
        flat, g = model.p[name].ravel(), grads[name].ravel()
        for i in np.r_[np.abs(g).argsort()[-4:], rng.integers(0, len(flat), 2)]:
            if name == "embedding" and i < langid.EMBEDDING:
                continue
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3


def test_the_query_is_the_network_window_by_window(spark, sf_dir):
    """Every whole text, by the filters themselves and one window at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(langid.training_windows(docs.select("doc_id", "text", "lang")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = langid.op7_language_id(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        data = (texts[r["doc_id"]] or "").lower().encode().replace(b"\0", b" ")
        if not langid.has_letter(texts[r["doc_id"]]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = np.zeros(len(model.classes))
        for i in range(0, len(data), langid.WINDOW):
            piece = data[i : i + langid.WINDOW]
            x = np.frombuffer(piece.ljust(langid.WINDOW, b"\0"), np.uint8)[None]
            total += len(piece) * model._softmax(model._pool(model._responses(x)[0].max(axis=1)))[0]
        p = total / len(data)
        assert abs(r["score"] - p.max()) < 1e-4 and p[model.classes.index(r["lang_pred"])] > p.max() - 1e-4

import numpy as np
from pyspark.sql import functions as F

from cardlens.llm import toxicity

from .util import empty_documents, odd_documents, with_clashes


def corpus(n=600, seed=0):
    """Clean rows, and rows with one to nine of ten bad words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"word{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (80, 2))]
        bad = int(rng.integers(2, 10)) if i % 3 == 0 else 0
        words += [f"nasty{chr(97 + j)}" for j in rng.choice(10, bad, replace=False)]
        rows.append((i, " ".join(rng.permutation(words)), int(bad > 0), bad))
    return rows


def tables(spark, rows):
    """Labels of grades 0 to 3, by the number of bad words."""
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, -(-bad // 3)) for i, _, _, bad in rows], "doc_id long, grade int")


def test_grades_rise_with_severity_on_held_out_rows(spark):
    rows = corpus()
    model = toxicity.taught(*tables(spark, [r for r in rows if r[0] % 2]))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    held = [r for r in rows if not r[0] % 2]
    above = model.above([t for _, t, _, _ in held])
    assert (np.diff(above, axis=1) <= 1e-12).all()
    assert np.mean((above[:, 0] >= 0.5) == np.array([y for _, _, y, _ in held])) > 0.97
    bad = np.array([b for _, _, _, b in held])
    assert np.corrcoef(above.sum(axis=1), bad)[0, 1] > 0.9


def test_features_are_chosen_as_by_brute_force(spark):
    rows = corpus(200)
    docs, labels = tables(spark, rows)
    found, shift = toxicity.sample(docs, labels)
    want = []
    sets = {i: {f.decode("latin-1") for f in toxicity.features(toxicity.words(t))} for i, t, _, _ in rows}
    for f in sorted(set().union(*sets.values())):
        cells = np.array([[sum((f in sets[i]) == has and y == kind for i, _, y, _ in rows) for has in (True, False)] for kind in (0, 1)], float)
        expected = np.outer(cells.sum(axis=1), cells.sum(axis=0)) / cells.sum()
        if 2 * sum(c * np.log(c / e) for c, e in zip(cells.ravel(), expected.ravel(), strict=True) if c) >= toxicity.LEAST_G2:
            want.append(f)
    chosen = toxicity.vocabulary(found)
    assert chosen == want and "nastya" in chosen and shift == 0
    assert {i: set(at) for i, (_, at) in enumerate(toxicity.training_rows(found, chosen))} == {i: {chosen.index(f) for f in s if f in chosen} for i, s in sets.items()}


def test_the_end_of_a_long_text_teaches_too(spark):
    rows = [(i, "fine word " * 5_000 + ("nasty" if i % 3 == 0 else "nice"), int(i % 3 == 0), 3 * int(i % 3 == 0)) for i in range(90)]
    model = toxicity.taught(*tables(spark, rows))
    assert model.weights[b"nasty"] > 0 > model.weights[b"nice"]


def test_severities_of_the_query_are_those_of_the_model_row_by_row(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.taught(docs, labels.select("doc_id", toxicity.default_grade().alias("grade")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = toxicity.op1_toxicity(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        x = sum(model.weights.get(f, 0.0) for f in toxicity.features(toxicity.words(texts[r["doc_id"]]))) if model else 0
        p = [1 / (1 + np.exp(t - x)) for t in model.thresholds] if model else [0.0]
        assert abs(r["severity"] - sum(p)) < 1e-9 and r["grade"] == sum(v >= 0.5 for v in p) and r["toxic"] == (p[0] >= 0.5)


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    taught = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0)
    out = toxicity.severities(docs, taught).join(labels.join(taught.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    assert (out.toxic == (out.label == 1)).mean() > 0.97
    assert out[out.label == 0].toxic.mean() < 0.02
    assert out[out.label == 1].toxic.mean() > 0.75


def test_defined_cases(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 4, 5, 7, 8, 99)] + [(None, None, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.severities(with_clashes(docs), with_clashes(labels))
    assert out.count() == docs.count()
    assert all(0 <= r["severity"] <= 2 and r["grade"] <= 2 for r in out.collect())
    assert toxicity.severities(empty_documents(spark), labels).count() == 0
    assert {r["severity"] for r in toxicity.severities(docs, labels.limit(0)).collect()} == {0.0}


def test_reruns_agree(spark, sf_dir):
    first, again = (sorted(map(tuple, toxicity.op1_toxicity(spark, sf_dir).collect())) for _ in range(2))
    assert first == again and len(first) == 200

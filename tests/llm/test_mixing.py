from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cardlens.llm import mixing

from .util import empty_documents, odd_documents, rows_of, with_clashes


def check(rows, sources):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["target"], r["source_size"]].append(r)
    total = sum(r["size"] for r in rows)
    assert sum(t for t, _ in by_source if t) == pytest.approx(1.5 * total) or not total
    for (target, size), own in by_source.items():
        assert target <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in own) - target) <= len(own) + 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_targets_and_taken_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, again = mixing.op2_source_mix(spark, sf_dir), mixing.op2_source_mix(spark, sf_dir)
    assert rows_of(first) == rows_of(again)
    rows = first.collect()
    assert len(rows) == docs.count()
    check(rows, docs)


def test_whole_epochs_come_first(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "s" if i < 40 else "t", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.mix(docs).collect()
    small = [r for r in rows if r["source_size"] == 80]
    assert {r["source_size"]: r["target"] for r in rows} == pytest.approx({160: 360 * 5 / 7, 80: 360 * 2 / 7})
    assert all(r["epochs"] == 1 and r["taken"] >= 4 for r in small)


def test_defined_cases(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs)
    assert out.count() == docs.count()
    assert rows_of(out) == rows_of(mixing.mix(with_clashes(docs)))
    assert all(r["size"] == 0 and r["taken"] == 0 for r in out.collect() if r["doc_id"] in (3, 4, 6))
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_mixed_documents_keep_columns_and_repeat(spark):
    docs = with_clashes(odd_documents(spark))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
    got = {(r["doc_id"], r["size"]): r["n"] for r in mixed.withColumn("size", mixing.words()).groupBy("doc_id", "size").agg(F.count("*").alias("n")).collect()}
    for key, n in got.items():
        repeats = 2 if key in ((2, 15), (None, 8)) else 1
        assert n == copies[key] * repeats
    assert mixing.mixed_documents(empty_documents(spark)).count() == 0


def test_an_exact_sort_gives_the_same_selection(spark):
    """Against one sort of a source's keys in the driver, over more rows than a bucket holds."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"), F.lit("en").alias("lang")).unionByName(spark.range(9000, 9300).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("x y z").alias("text"), F.lit("en").alias("lang")))
    rows = mixing.keyed(docs).collect()
    out = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    for source in "ab":
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: r["key"])
        one = out[own[0]["doc_id"]]
        left = int(one["target"]) - one["epochs"] * one["source_size"]
        for r in own:
            part = max(0, min(r["size"], left))
            assert out[r["doc_id"]]["taken"] == one["epochs"] * r["size"] + part
            left -= r["size"]

import sys

import pytest

from cardlens.llm import registry
from cardlens.llm.common import written

from .test_bpe import expected
from .util import empty_documents, odd_documents, rows_of, save, with_clashes

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name in ("language_id", "line_dedup"):
            assert n * 0.95 <= docs.count() <= n
    from tokenizers import Tokenizer

    from cardlens.llm.bpe import default_vocabulary

    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = sorted((expected(tokenizer, r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert rows_of(pipeline.STAGES[-1][1](spark, docs, sf_dir)) == want
    assert rows_of(pipeline.run(spark, sf_dir)) == want


def test_defined_cases(spark, tmp_path):
    for i, docs in enumerate((with_clashes(odd_documents(spark)), empty_documents(spark))):
        folder = tmp_path / str(i)
        out = pipeline.run(spark, save(docs, folder))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() == 0) == (i == 1)


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert "cardlens.llm" in sys.modules

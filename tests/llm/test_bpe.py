import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.llm import bpe

from .util import empty_documents, odd_documents, rows_of, with_clashes

TEXTS = ["it's 'll we've <|endoftext|>x", "  two  spaces \n\n\t tabs  ", "中文 текст ٠١ Ⅷ ½²", "\U0001f600 é ​ \u0085 x\x00\x1c", "a" * 5000, "<|endoftext|><|endoftext|>", "ÿþ ſ ƀ", " ", "\r\n\r\n a", "\U000e0fff unassigned\u0378 \u0378x", "a<|endoftext|> b \u0378"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def expected(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())


def test_ids_equal_the_tokenizers(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert Counter(map(tuple, bpe.op9_bpe(spark, sf_dir).collect())) == Counter(expected(tokenizer, r["doc_id"], r["text"]) for r in docs)


def test_defined_cases(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 50)
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    out = bpe.round_trip(with_clashes(docs))
    assert Counter(map(tuple, out.collect())) == Counter(expected(tokenizer, r["doc_id"], r["text"]) for r in docs.collect())
    assert bpe.round_trip(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("text", TEXTS)
def test_words_and_pieces(text, tokenizer):
    path = bpe.default_vocabulary()
    words = bpe.split(text, path)
    assert "".join(words) == text
    if "<|" not in text:
        assert words == [text[s:e] for _, (s, e) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(bpe.pieces(path)[i] for i in ids).decode() == text


def test_words_of_every_character(spark):
    """Spark's words are the tokenizer's for every character that Java knows, and leave no other out unseen."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(bpe.default_vocabulary()).pre_tokenizer.pre_tokenize_str
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}{chr(c)} x\n" for c in codes[i : i + 8]) for i in range(0, len(codes), 8)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for text, words in df.select("text", bpe._words(F.col("text"))).collect():
        if "".join(words) == text:
            assert words == [text[s:e] for _, (s, e) in cut(text)]


def test_long_texts_are_split_in_pieces(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 30)
    texts = ["it's  a long\n\n text of  many words, 'll be cut " * 9, "x" * 100 + " \n " + "y" * 50, " " * 70, "a" + " " * 70 + "b", "z" * 20 + " z", "", "end <|endoftext|> of text\u0378 and more of it to come"]
    docs = spark.createDataFrame([(i % 5 or None, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").coalesce(2)
    cut = docs.select("text", bpe._text_pieces(F.col("text")).alias("p")).collect()
    assert all("".join(x["text"] for x in r["p"]) == r["text"] and [x["first"] for x in r["p"]] == [True] + [False] * (len(r["p"]) - 1) for r in cut)
    assert max(len(r["p"]) for r in cut) > 9
    assert Counter(map(tuple, bpe.round_trip(docs).collect())) == Counter(expected(tokenizer, r["doc_id"], r["text"]) for r in docs.collect())


def test_texts_are_split_once(spark, sf_dir):
    out = bpe.op9_bpe(spark, sf_dir)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1 and plan.split("== Initial Plan ==")[0].count("- Exchange hashpartitioning(") == 2


def test_decoding_joins_any_ids(spark):
    path = bpe.default_vocabulary()
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 1, 1000, 50_000)] + [np.array([50256, 60000, 5], "<u4")]
    pieces = bpe.pieces(path)
    for x in ids:
        assert bpe.joined_pieces(x, bpe.vocabulary(path)).to_pylist() == [pieces[i] if i < len(pieces) else b"" for i in x]
    out = bpe.decode(spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(ids)] + [(9, None)], "n int, ids binary"), path)
    want = {i: b"".join(pieces[j] if j < len(pieces) else b"" for j in x).decode(errors="replace") for i, x in enumerate(ids)} | {9: ""}
    assert {r["n"]: r["decoded"] for r in out.collect()} == want


def test_encode_then_decode_is_the_text(spark):
    docs = odd_documents(spark)
    decoded = bpe.decode(bpe.encode(docs))
    assert rows_of(decoded.select("doc_id", "decoded")) == rows_of(docs.selectExpr("doc_id", "coalesce(text, '') AS decoded"))

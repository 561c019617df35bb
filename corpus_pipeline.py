"""A corpus pipeline over documents: language ID, line dedup, near-dedup, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of docs.
Between stages run() writes Parquet to the shared folder and reads it again.

Defined cases are those of the operators; a document whose lines are all repeated elsewhere stays, with an empty text,
until near-dedup puts it together with other empty ones, and the mix takes no document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardlens.llm import bpe, langid, line_dedup, mixing, simhash_dedup
from cardlens.llm.common import discard, fresh_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without one (und) or of too low a score go."""
    return langid.known_languages(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template occurred in another document before."""
    return line_dedup.without_repeated_lines(docs, whole=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component."""
    return simhash_dedup.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe_ids),
]
#: Language ID, fingerprints and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the tables between stages only the last stage's input stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

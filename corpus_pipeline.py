"""A corpus pipeline of training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written as
Parquet and read again before the next.  All but the last return the columns of documents.

Rows with nulls in other columns than text are ordinary rows in every stage, further columns are
kept whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratograph.llm import decontamination, language_id, mixing, ngram_join, token_output
from stratograph.llm.common import written

#: No SQL: language ID, retrieval and BPE cannot be said in it; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Texts that are null, empty or without a letter go, and those whose best language has a
    posterior below a half.  Equal texts have one fate; of a tie the first language counts."""
    return language_id.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8.

    The smallest doc_id of a group stays, one row of it; rows without a doc_id all stay, and so
    do texts without words.  Texts of fewer than five words are one shingle."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own text, whole, whatever its doc_id; null and empty texts and
    items match nothing."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, as often as it takes them.

    A null source is a source of its own; null and empty texts have size 0 and cost nothing.
    Rows that repeat are rows each; reruns agree."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the token files.

    Null texts hold the end id alone; null doc_ids come first; repeated rows have places each."""
    return token_output.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

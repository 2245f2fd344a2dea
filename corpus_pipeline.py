"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm._store import store
from lodestone.llm.decontaminate import clean_documents
from lodestone.llm.mixing import Mix, take_documents
from lodestone.llm.ngram_jaccard import keep_one
from lodestone.llm.quality_crf import keep_good, remainder
from lodestone.llm.token_output import token_tables

#: Each document is in the mixture once at most; three quarters of the tokens that the stages before keep.
MIX = Mix(domains={"web": 5, "books": 3, "forum": 1, "reference": 1}, langs={"en": 4, "de": 3, "fr": 2, "es": 1}, percent=75, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores at its threshold or above."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder() != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingle sets at a similarity of 0.8 connect: that with the least doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, whole."""
    return take_documents(docs, MIX)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and per document what they hold: doc_id, start, n_tokens, ids_crc32."""
    return token_tables(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The classifier, the similarity join and the tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxicity, exact and near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``. A row is judged by its own text, so ids may repeat with different texts and may be null.
Each stage of an empty table gives an empty table; columns besides ``doc_id`` and ``text`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import materialize
from quillmark.llm.decontamination import without_leaks
from quillmark.llm.exact import one_of_each_text
from quillmark.llm.minhash import one_of_each
from quillmark.llm.packing import pack_documents
from quillmark.llm.toxicity import learn, without_toxic
from quillmark.session import ship

#: Learned scores, set similarities and token ids can't be expressed in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; null and empty texts stay."""
    ship(spark)
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, and of rows repeated whole one; null counts as empty."""
    ship(spark)
    return one_of_each_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8) the one with the smallest doc_id stays.

    Documents without words stand alone and stay; a null doc_id stays only where its group has no other.
    """
    ship(spark)
    return one_of_each(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go; null and empty texts stay."""
    ship(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into windows of 4096 tokens; a null or empty text is its end token alone."""
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

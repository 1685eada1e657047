"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadtime.llm.catalogue import tokenizer_path
from leadtime.llm.common import ship, written
from leadtime.llm.mixing import mixed_documents
from leadtime.llm.packing import pack_documents
from leadtime.llm.resampling import select_quality
from leadtime.llm.simhash import keep_one
from leadtime.llm.substrings import remove_repeated

#: No SQL states sampled, fingerprinted or packed rows; tests compare every stage with a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones selects."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash over five-word shingles."""
    return keep_one(docs, width=5, similarity=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start anywhere else in the corpus too."""
    return remove_repeated(docs, length=200, count="n_chars").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 5, 2, 1, each taken three times at most, as documents."""
    return mixed_documents(docs, weights=(5, 2, 1), cap=3, block_words=64)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix in sequences of 4096."""
    return pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of the training-data operators over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.llm.common import ship
from leadtime.llm.embeddings import near_vectors
from leadtime.llm.language import held_out, identify_languages
from leadtime.llm.lexical import SQL as LEXICAL_SQL
from leadtime.llm.lexical import rank_documents
from leadtime.llm.maxscore import SQL as MAXSCORE_SQL
from leadtime.llm.maxscore import top_inner_products
from leadtime.llm.mixing import mix, taken
from leadtime.llm.packing import pack_documents
from leadtime.llm.prefix_trie import SQL as TRIE_SQL
from leadtime.llm.prefix_trie import conversation_nodes
from leadtime.llm.quality_rules import quality_rules
from leadtime.llm.quality_sql import SQL as QUALITY_SQL
from leadtime.llm.resampling import resample
from leadtime.llm.scoring import score_documents
from leadtime.llm.sharding import even_tree, shard_documents
from leadtime.llm.simhash import simhash_groups
from leadtime.llm.substrings import remove_repeated

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = shipped
    return shipped


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir, "doc_id", "text"), width=3, distance=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir, "doc_id", "text", "source"), weights=(5, 2, 1), cap=3, block_words=64)
    return taken(mixed).select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


@query
def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return resample(documents(spark, sf_dir, "doc_id", "text"), labels)


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(16, racks=2, per_rack=4)
    placed = shard_documents(
        documents(spark, sf_dir, "doc_id", "text"), tree, grown=even_tree(17, built=16, racks=2, per_rack=4)
    )
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify_languages(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"), 4)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


@query
def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    freed = remove_repeated(documents(spark, sf_dir, "doc_id", "text"), length=200)
    return freed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = score_documents(docs, docs.where(~held_out(F.col("doc_id"), 7)))
    return scored.withColumn("held_out", held_out(F.col("doc_id"), 7))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir, "doc_id", "text")).drop("cleaned")


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return rank_documents(documents(spark, sf_dir, "doc_id", "text"), items, k=10)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"), every=100, limit=6)


@query
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_inner_products(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


# Fingerprints, draws, tokens, models and suffix orders are not SQL; rules per line, ranks, tries and inner products are.
ORACLE["op10_quality_rules"] = QUALITY_SQL
ORACLE["op11_lexical_search"] = LEXICAL_SQL
ORACLE["op12_prefix_trie"] = TRIE_SQL
ORACLE["op13_exact_topk"] = MAXSCORE_SQL

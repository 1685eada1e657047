"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadtime.llm.catalogue import tokenizer_path
from leadtime.llm.embeddings import near_vectors
from leadtime.llm.language import identify_languages
from leadtime.llm.mixing import mix, mixed_documents, taken
from leadtime.llm.packing import pack_documents
from leadtime.llm.quality_rules import quality_rules
from leadtime.llm.resampling import resample, select_quality
from leadtime.llm.scoring import score_documents
from leadtime.llm.sharding import even_tree, shard_documents
from leadtime.llm.simhash import keep_one, simhash_groups
from leadtime.llm.substrings import remove_repeated

LONG = "word over and over again, longer than any other. " * 60_000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog.\nThe dog looked back at it.", "en", "a"),
    (2, "the cat sat on the mat and looked at the dog.\nThe dog looked back at it.", "en", "a"),
    (2, "the cat sat on the mat and looked at the dog.\nThe dog looked back at it.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n\x0b\x0c\r ", "de", "b"),
    (6, "der hund und die katze sind nicht in dem haus, und der mann ist auch nicht da.", "de", None),
    (None, "une phrase sans numéro, avec des mots français et une fin.", "fr", "c"),
    (None, None, None, None),
    (7, LONG, "en", "c"),
    (8, "¿¡ 1234 !!", "es", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Columns whose names the operators use for themselves.
CLASHING = ["fp", "component_id", "shard", "slot", "size", "rank", "start", "name", "content", "runs", "bytes", "words", "score", "n", "class", "quality", "spans", "target", "node", "first", "copies"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (6, 1), (8, 0), (2, None), (None, 1), (6, 1)], "doc_id long, quality int")


OPERATORS = {
    "simhash": lambda d, l: simhash_groups(d),
    "keep_one": lambda d, l: keep_one(d),
    "mix": lambda d, l: taken(mix(d)),
    "mixed_documents": lambda d, l: mixed_documents(d),
    "pack": lambda d, l: pack_documents(d, tokenizer_path()),
    "resample": lambda d, l: resample(d, l),
    "select_quality": lambda d, l: select_quality(d, l),
    "shard": lambda d, l: shard_documents(d, even_tree(16, racks=2)),
    "language": lambda d, l: identify_languages(d, d),
    "repeated": lambda d, l: remove_repeated(d),
    "score": lambda d, l: score_documents(d, d),
    "rules": lambda d, l: quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(none, labels, name):
    assert OPERATORS[name](none, labels).collect() == []


def test_empty_labels_reject_nothing(docs, labels):
    assert select_quality(docs, labels.where("false")).count() == len(ROWS)


def test_simhash(docs):
    found = {(r.doc_id, r.fp): r.component_id for r in simhash_groups(docs).collect()}
    assert simhash_groups(docs).count() == len(ROWS)
    assert found[3, 0] == found[4, 0] == found[5, 0] == found[None, 0] == 3
    assert {c for (i, _), c in found.items() if i in (1, 2)} == {1}


def test_keep_one(docs):
    kept = keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]
    assert sum(r.doc_id is None for r in kept) == 2
    assert keep_one(docs).columns == docs.columns


def test_mix(docs):
    rows = taken(mix(docs, block_words=4)).collect()
    assert len(rows) == len(ROWS) and sum(r["size"] == 0 for r in rows) == 4
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mixed_documents(docs, block_words=4).columns == docs.columns


def test_pack(docs):
    rows = pack_documents(docs, tokenizer_path()).collect()
    ones = [r for r in rows if r.length == 1]
    assert len(ones) == 4 and {r.ids_crc32 for r in ones} == {zlib.crc32(b"\x01\0\0\0")}
    assert sum(r.doc_id == 2 for r in rows) == 2
    assert max(r.piece for r in rows if r.doc_id == 7) == -(-sum(r.length for r in rows if r.doc_id == 7) // 4096) - 1


def test_resample(docs, labels):
    rows = resample(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert {r.log_weight for r in rows if r.doc_id in (3, 4, 5)} == {0.0}
    assert len({r.selected for r in rows if r.doc_id == 2}) == 1


def test_shard(docs):
    rows = shard_documents(docs, even_tree(16, racks=2), grown=even_tree(17, built=16, racks=2)).collect()
    assert len(rows) == len(ROWS)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r["size"] for r in rows if r.doc_id in (3, 4)} == {1}


def test_language(docs):
    rows = {r.doc_id: r for r in identify_languages(docs.where("doc_id is not null"), docs).collect()}
    assert [rows[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4
    assert rows[6].lang_pred == "de" and rows[1].lang_pred == "en" and rows[7].lang_pred == "en"
    assert {r.lang_pred for r in identify_languages(docs, docs.where("false")).collect()} == {"und"}


def test_repeated(docs):
    rows = remove_repeated(docs).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r for r in rows}
    assert of[7].n_removed == of[7].n_bytes == len(LONG) and of[7].n_spans == 1 and of[7].text == ""
    assert of[3].text is None and of[4].text == "" and of[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert of[1].n_removed == 0 and of[1].text == ROWS[0][1]


def test_score(docs):
    rows = score_documents(docs, docs.where("doc_id = 1 or doc_id = 6")).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r for r in rows}
    assert of[3].n_tokens == of[4].n_tokens == of[5].n_tokens == 1
    assert of[2].base_score == of[1].base_score and of[7].n_tokens == len(LONG.split()) + 1
    assert {r.base_score for r in score_documents(docs, docs.where("false")).collect()} == {0.0}


def test_rules(docs):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert {r.kept for r in rows if r.doc_id in (1, 2)} == {True}


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, []), (10, [1e38, 1e37])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x"))
    found = sorted(near_vectors(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in found] == [
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 3, 1, False), (None, 0, None, False),
    ]
    assert near_vectors(df.where("false")).collect() == []


def test_pipeline_on_odd_rows(docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark = docs.sparkSession
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, step, str(tmp_path)).columns == step.columns

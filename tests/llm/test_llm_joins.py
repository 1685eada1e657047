"""Rows that were unfolded are not broadcast, however small Spark takes them to be."""

import pytest
from pyspark.sql import DataFrame

from leadtime.llm import simhash
from leadtime.llm.mixing import mix, mixed_documents, taken


def sent_whole(df: DataFrame, but: str = "") -> list[str]:
    """What of the plan is broadcast and unfolds rows itself; not what ``but`` stands over, if given."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i] or but and but in lines[j]:
                    break
                if "Generate" in lines[j]:
                    found.append(lines[j])
    return found


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 311}" for j in range(40 + i % 90)), "abc"[i % 3]) for i in range(120)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    return spark.read.parquet(path)


def test_blocks_of_a_mix_are_not_broadcast(docs):
    for df in (taken(mix(docs, block_words=4)), mixed_documents(docs, block_words=4)):
        assert not sent_whole(df)
        assert len(df.collect()) >= 120
        assert "isFinalPlan=true" in df._jdf.queryExecution().executedPlan().toString()
        assert not sent_whole(df)


def test_blocks_of_fingerprints_are_not_broadcast(docs, monkeypatch):
    frames = []
    written = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: frames.append(df) or written(df))
    simhash.wide_groups(docs, width=5, similarity=0.8).collect()
    assert any("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in frames)
    # Of blocks only how many texts a crowded one holds may be sent.
    assert not [line for df in frames for line in sent_whole(df, but="Aggregate")]

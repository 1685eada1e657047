import pytest
from pyspark.sql import functions as F

from leadtime.operators import indexing, learn
from leadtime.operators.split import split_frames
from leadtime.session import shared_folder
from leadtime.sources.stages import (
    input_state,
    load_model,
    persisted,
    prune_stage,
    read_stage,
    restage,
    save_model,
    stage_exists,
    stage_once,
    write_stage,
)
from leadtime.sources.tables import delimited_lookup, scan_csv, scan_parquet


def test_stages(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        read_stage(spark, root, "s", "original")
    write_stage(spark.range(3), root, "s", "original")
    assert stage_exists(spark, root, "s", "original")
    older = read_stage(spark, root, "s", "original")
    write_stage(spark.range(5), root, "s", "original")
    assert read_stage(spark, root, "s", "original").count() == 5
    # Who reads the older version is not cut off until it is pruned.
    assert older.count() == 3
    assert prune_stage(spark, root, "s", "original") == 1 and read_stage(spark, root, "s", "original").count() == 5
    assert restage(spark.range(2), root, "s", "other").count() == 2


def test_half_written_stage_does_not_count(spark, tmp_path):
    root, half = str(tmp_path), tmp_path / "s" / "half" / "00000000000000000001-half"
    half.mkdir(parents=True)
    (half / "_manifest.1").write_text("{")
    assert not stage_exists(spark, root, "s", "half")
    assert stage_once(spark, root, "s", "half", lambda: spark.range(4)).count() == 4
    assert stage_once(spark, root, "s", "half", lambda: 1 / 0).count() == 4


def test_changed_inputs_or_parameters_compute_anew(spark, tmp_path):
    root, source, calls = str(tmp_path / "root"), str(tmp_path / "source"), []

    def staged(parameters, frame="read"):
        rows = spark.read.schema("id long").parquet(source) if frame == "read" else frame

        def compute():
            calls.append(parameters)
            return rows.selectExpr("id + 1 AS id")

        return stage_once(spark, root, "s", "next", compute, parameters=parameters, inputs=[rows]).count()

    spark.range(3).write.parquet(source)
    assert staged({"a": 1}) == 3 and staged({"a": 1}) == 3 and calls == [{"a": 1}]
    spark.range(3).write.mode("overwrite").parquet(source)  # same rows, another file
    assert staged({"a": 1}) == 3 and len(calls) == 2
    spark.range(2).write.mode("append").parquet(source)
    assert staged({"a": 1}) == 5 and len(calls) == 3
    assert staged({"a": 2}) == 5 and len(calls) == 4
    assert staged({"a": 2}) == 5 and len(calls) == 4
    # An input that is not given is not asked about; one that is no file counts by its plan.
    assert stage_once(spark, root, "s", "next", lambda: 1 / 0, parameters={"a": 2}, inputs=[None]).count() == 5
    assert staged({"a": 2}, spark.range(9)) == 9 and staged({"a": 2}, spark.range(9)) == 9 and len(calls) == 5
    assert input_state(None) is None


def test_ranges_of_a_stage_laid_out_by_time_skip_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id", "(id * 7919) % 40000 AS t")
    files = {}
    for name, layout in (("by time", {"cluster_by": "t"}), ("as it comes", {})):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            staged = restage(rows.repartition(8), str(tmp_path), "s", name.replace(" ", "_"), **layout)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        bounds = staged.groupBy(F.input_file_name().alias("f")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
        files[name] = sum(b.hi > 36_000 for b in bounds), len(bounds)
        frames = split_frames(staged, "t", 0.9, 0.05)
        assert [frames[p].count() for p in ("train", "val", "test")] == [36_000, 2_000, 2_000]
    assert files["as it comes"][0] == files["as it comes"][1] >= 8
    assert files["by time"][0] <= 2 and files["by time"][1] >= 8


def test_models_keep_their_versions(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    first = save_model(learn.category_indexer(["c"]).fit(df), str(tmp_path), "m", {"run": 1})
    second = save_model(learn.category_indexer(["c"]).fit(df.where("c = 'a'")), str(tmp_path), "m")
    assert first != second
    assert load_model(indexing.LevelIndexerModel, str(tmp_path), "m").getSizes() == [1]
    assert indexing.LevelIndexerModel.load(first).getSizes() == [2]
    with pytest.raises(ValueError):
        load_model(indexing.LevelIndexerModel, str(tmp_path), "none")


def test_persisted_is_released(spark):
    df = spark.range(3)
    with persisted(df) as (kept,):
        assert kept.count() == 3 and kept.is_cached
    assert not df.is_cached


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert named is None or folder == named


def test_delimited_lookup(spark, tmp_path):
    path = tmp_path / "codes.txt"
    path.write_text("KAAA:AAA:Name:x\nKBBB:N/A:Name\nKCCC:CCC\nKA2:AAA:again\nno separator\n\n")
    got = delimited_lookup(spark, str(path), value="CALL", key="ORIGIN").collect()
    assert {(r.ORIGIN, r.CALL) for r in got} == {("AAA", "KA2"), ("CCC", "KCCC")}


def test_csv_and_glob(spark, tmp_path):
    (tmp_path / "stations.csv").write_text("usaf,wban,lat\n007,1,4.5\n,2,\n")
    got = scan_csv(spark, str(tmp_path / "stations.csv"), schema="usaf string, wban string, lat double").collect()
    assert got == [("007", "1", 4.5), (None, "2", None)]
    for part in (1, 2):
        spark.range(part).write.parquet(f"{tmp_path}/data/part{part}.parquet")
    assert scan_parquet(spark, f"{tmp_path}/data/*.parquet", columns=["id"]).count() == 3

"""Named stages of a flow on shared storage, and the models saved beside them.

A stage is a folder ``root/scope/name`` of versions. Every write makes a new version; its manifest, written
last, publishes it: it tells by which parameters and from which state of the inputs the version was made, and its
schema. The current version is the newest with a manifest. So a half-written version does not count, a flow that lost its
driver starts again from the last whole stage, and whoever still reads an older version is not cut off.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest"


def stage_path(root: str, scope: str, stage: str) -> str:
    return f"{root.rstrip('/')}/{scope}/{stage}"


@dataclass(frozen=True)
class Version:
    """A published version: its folder, parameters, the state of each input, and the schema as JSON (null for a model)."""

    path: str
    parameters: dict[str, Any]
    inputs: list[dict[str, Any] | None]
    schema: dict[str, Any] | None

    def fits(self, parameters: Mapping[str, Any], inputs: Sequence[dict[str, Any] | None]) -> bool:
        """Whether it was made by these parameters from inputs in these states; an input of None is not asked about."""
        same = len(inputs) == len(self.inputs) and all(b is None or a == b for a, b in zip(self.inputs, inputs))
        return same and self.parameters == json.loads(json.dumps(dict(parameters)))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType.fromJson(self.schema)).parquet(self.path)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def input_state(frame: DataFrame | None) -> dict[str, Any] | None:
    """What tells whether a frame's input files have changed: folders, number, bytes, and a digest over names, lengths and times.

    The files are listed by Spark and digested as a table, without their contents. A frame that does not come
    from files is known by its plan, which holds within a session; None has no state.
    """
    if frame is None:
        return None
    folders = sorted({path.rsplit("/", 1)[0] for path in frame.inputFiles()})
    if not folders:
        return {"plan": frame.semanticHash()}
    listed = frame.sparkSession.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    row = listed.agg(
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("digest"),
    ).first()
    return {"folders": folders, **row.asDict(), "columns": frame.schema.simpleString()}


def _new_version(folder: str) -> str:
    return f"{folder}/{time.time_ns():020d}-{uuid4().hex[:8]}"


def _publish(spark: SparkSession, path: str, parameters: Mapping[str, Any], inputs: Sequence[dict | None], schema: dict | None) -> Version:
    text = json.dumps({"parameters": dict(parameters), "inputs": list(inputs), "schema": schema})
    files, half = _files(spark, f"{path}/{MANIFEST}.{uuid4().hex}")
    stream = files.create(half)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.rename(half, _files(spark, f"{path}/{MANIFEST}")[1])
    return Version(path, **json.loads(text))


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the published versions, newest first."""
    files, place = _files(spark, folder)
    if not files.exists(place):
        return []
    names = sorted((s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()), reverse=True)
    return [f"{folder}/{n}" for n in names if files.exists(_files(spark, f"{folder}/{n}/{MANIFEST}")[1])]


def _current(spark: SparkSession, folder: str) -> Version | None:
    for path in _versions(spark, folder):
        files, manifest = _files(spark, f"{path}/{MANIFEST}")
        stream = files.open(manifest)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(path, **json.loads(text))
    return None


def current_stage(spark: SparkSession, root: str, scope: str, stage: str) -> Version | None:
    return _current(spark, stage_path(root, scope, stage))


def stage_exists(spark: SparkSession, root: str, scope: str, stage: str) -> bool:
    return bool(_versions(spark, stage_path(root, scope, stage)))


def write_stage(
    df: DataFrame,
    root: str,
    scope: str,
    stage: str,
    *,
    parameters: Mapping[str, Any] | None = None,
    inputs: Sequence[dict[str, Any] | None] = (),
    cluster_by: str | None = None,
) -> Version:
    """Write and publish a new version; older ones stay until ``prune_stage``.

    ``cluster_by`` range-partitions the rows by that column and sorts them by it within files, so that range
    filters on it skip whole files and row groups.
    """
    spark, path = df.sparkSession, _new_version(stage_path(root, scope, stage))
    laid = df if cluster_by is None else df.repartitionByRange(F.asc_nulls_last(cluster_by)).sortWithinPartitions(F.asc_nulls_last(cluster_by))
    laid.write.parquet(path)
    return _publish(spark, path, parameters or {}, inputs, df.schema.jsonValue())


def read_stage(spark: SparkSession, root: str, scope: str, stage: str) -> DataFrame:
    """The current version; what is read stays the same if a newer one is published meanwhile."""
    version = current_stage(spark, root, scope, stage)
    if version is None:
        raise ValueError(f"no stage at {stage_path(root, scope, stage)}")
    return version.read(spark)


def stage_once(
    spark: SparkSession,
    root: str,
    scope: str,
    stage: str,
    compute: Callable[[], DataFrame],
    *,
    parameters: Mapping[str, Any] | None = None,
    inputs: Sequence[DataFrame | None] = (),
    cluster_by: str | None = None,
) -> DataFrame:
    """The stage as written before by the same ``parameters`` from ``inputs`` in the same state, or else computed and written.

    The state is taken before computing, so a change meanwhile makes the next call compute again.
    """
    states = [input_state(frame) for frame in inputs]
    version = current_stage(spark, root, scope, stage)
    if version is None or not version.fits(parameters or {}, states):
        version = write_stage(compute(), root, scope, stage, parameters=parameters, inputs=states, cluster_by=cluster_by)
    return version.read(spark)


def restage(df: DataFrame, root: str, scope: str, stage: str, **layout: Any) -> DataFrame:
    """Write a new version of the stage and go on from just that."""
    return write_stage(df, root, scope, stage, **layout).read(df.sparkSession)


def prune_stage(spark: SparkSession, root: str, scope: str, stage: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` published versions; gives how many went. Call it when no one reads them."""
    old = _versions(spark, stage_path(root, scope, stage))[max(1, keep) :]
    for path in old:
        files, place = _files(spark, path)
        files.delete(place, True)
    return len(old)


@contextmanager
def persisted(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Frames kept on executors, spilling to their disks, for the length of a ``with`` block."""
    kept = tuple(f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames)
    try:
        yield kept
    finally:
        for frame in kept:
            frame.unpersist()


def save_model(model, root: str, name: str, parameters: Mapping[str, Any] | None = None) -> str:
    """Save a model as a new version under ``root/models/name``; gives the version's folder."""
    spark = SparkSession.active()
    path = _new_version(stage_path(root, "models", name))
    model.write().save(path)
    return _publish(spark, path, parameters or {}, [], None).path


def load_model(kind: type, root: str, name: str):
    """Load the current version of a saved model; ``kind`` is its class, such as ``PipelineModel``."""
    version = _current(SparkSession.active(), stage_path(root, "models", name))
    if version is None:
        raise ValueError(f"no model at {stage_path(root, 'models', name)}")
    return kind.load(version.path)

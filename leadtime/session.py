"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leadtime", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are written for.

    UTC keeps epoch arithmetic free of daylight saving; the skew-join settings let
    Spark split a hot join key over several tasks, also when that costs a shuffle.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, made known to the context.

    Only a session of one machine may do without the setting; it then gets a new temporary folder,
    which is removed when Python ends. Any other session, one of ``local-cluster`` too, must
    name one, since executors do not share local disks.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leadtime-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def query_root(spark: SparkSession) -> str:
    """A new folder below the shared one for what one query writes; removed when the application ends."""
    root = f"{shared_folder(spark).rstrip('/')}/{uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return root

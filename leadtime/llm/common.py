"""What the training-data operators share: written tables, words of long texts, dense numbering."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadtime.session import shared_folder

#: Words are runs of anything but the ASCII blanks; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"

#: Long texts are cut into pieces of about this many bytes, at blanks, so that lists of words stay small.
PIECE_BYTES = 1 << 20

#: Rows that one task numbers at a time.
SLICE_ROWS = 50_000
#: Equal rows that travel as one.
STEP = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for sessions started without it."""
    context = spark.sparkContext
    if any(f.endswith("/leadtime_llm.zip") for f in context._python_includes) or "leadtime_llm.zip" in context._python_includes:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    path = os.path.join(tempfile.mkdtemp(prefix="leadtime-"), "leadtime_llm.zip")
    with open(path, "wb") as file:
        file.write(packed.getvalue())
    context.addPyFile(path)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Unlike a checkpoint it is columnar and compressed, so it suits rows in the number of the
    input. The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/leadtime-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def text_pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces that end at a blank, so that no word is cut; a word longer than a piece stays whole."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, copies: str) -> DataFrame:
    """Add ``first``: how many rows of the same ``keys`` come before, counting a row ``copies`` times.

    ``order`` must tell the rows of a key apart (fold equal rows into ``copies`` before). A key's
    rows are cut by a hash of ``order`` into slices of about ``SLICE_ROWS``; a window numbers
    within a slice and the totals of the slices before are added, so no task sees a whole key.
    """
    keys, order = list(keys), list(order)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(SLICE_ROWS)).alias("__slices"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cut = df.alias("l").join(sizes.alias("r"), same).select(
        "l.*", F.pmod(F.xxhash64(*[F.col(f"l.{c}") for c in order]), F.col("r.__slices")).alias("__slice")
    )
    group = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "__slice").agg(F.sum(copies).alias("__n")).withColumn(
        "__start", F.coalesce(F.sum("__n").over(group), F.lit(0).cast("long"))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("__in", F.coalesce(F.sum(copies).over(inside), F.lit(0).cast("long")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__slice"]]
    return numbered.alias("l").join(starts.alias("r"), same).select(
        *[f"l.{c}" for c in df.columns], (F.col("l.__in") + F.col("r.__start")).alias("first")
    )


def unfolded(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that goes by sorting, so that no side is broadcast.

    Spark sizes rows that come of an ``explode``, and what is grouped of them, as if each had stayed one, so it would
    send a table of any size through the driver.
    """
    return df.hint("merge")


def stepped(folded: DataFrame) -> DataFrame:
    """Rows that stand for ``copies`` equal ones as rows of ``STEP`` copies at most: ``from``, those before, and ``n``.

    Numbered with ``from`` in the order, the steps of one row are dealt over many slices.
    """
    begins = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(STEP).cast("long"))
    steps = folded.withColumn("from", F.explode(begins))
    return steps.withColumn("n", F.least(F.lit(STEP).cast("long"), F.col("copies") - F.col("from"))).drop("copies")


def in_blocks(placed: DataFrame, cell: Sequence[str], spread: Sequence[str], size: int) -> DataFrame:
    """Rows of crowded cells in pairs of blocks, to be compared group by group of ``cell``, ``low`` and ``high``.

    A cell's rows fall by a hash of ``spread`` into blocks of about ``size``; every pair of blocks,
    also a block with itself, is a group of two blocks at most. ``own`` is the row's block. Cells
    of one row are left out.
    """
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"), F.count("*").alias("held"))
    blocked = placed.join(sizes.where("held > 1").drop("held"), list(cell)).withColumn(
        "own", F.pmod(F.xxhash64(*spread), F.col("blocks")).cast("int")
    )
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")

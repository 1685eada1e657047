"""Quality by importance resampling: hashed n-gram models of good and of all text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import text_pieces, written

#: Runs of letters, of digits, and of the same mark: words of an open vocabulary beside the marks around them.
TOKENS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^A-Za-z0-9\x80-\xff\s])\1*")
BUCKETS = 1 << 14
REMEMBERED = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of a token; capitals hash by their number of letters too, and so stay a feature of their own."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        loud = len(token) > 2 and token.isupper()
        value = self[token] = zlib.crc32(token.lower()) | (1 << 32 if loud else 0)
        return value


def grams(text: bytes | None, hashes: _Hashes) -> Iterator[np.ndarray]:
    """Buckets of a text's tokens, of pairs of neighbours, and of what neighbours have in common."""
    last = np.zeros(0, np.uint64)
    for piece in text_pieces(text or b""):
        found = np.fromiter((hashes[m.group()] for m in TOKENS.finditer(piece)), np.uint64)
        if not len(found):
            continue
        loud = found >> np.uint64(32)
        ids = np.concatenate([last, found])
        pairs = (ids[:-1] * MIX) ^ (ids[1:] + np.uint64(1))
        # That a token is said again, and that it is all capitals, tells of any vocabulary.
        again = np.where(ids[:-1] == ids[1:], np.uint64(11), np.uint64(13))
        mixed = np.concatenate([found * MIX, pairs * MIX, again * MIX, (loud + np.uint64(17)) * MIX])
        yield (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        last = found[-1:]


def _bytes(text: pa.StringScalar) -> bytes | None:
    buffer = text.as_buffer()
    return None if buffer is None else buffer.to_pybytes()


def _gram_counts(docs: DataFrame, ids: Broadcast) -> DataFrame:
    """``bucket``, ``n_target`` and ``n_raw`` over all rows of ``doc_id`` and ``bytes``; a task adds up first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes, good = np.zeros((2, BUCKETS), np.int64), _Hashes(), ids.value
        for batch in batches:
            for target, text in zip([i in good for i in batch.column(0).to_pylist()], batch.column(1)):
                for found in grams(text.as_py(), hashes):
                    n = np.bincount(found, minlength=BUCKETS)
                    counts[1] += n
                    if target:
                        counts[0] += n
        full = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[0, full]), pa.array(counts[1, full])], ["bucket", "n_target", "n_raw"])

    found = docs.select("doc_id", "bytes").mapInArrow(of, "bucket long, n_target long, n_raw long")
    return found.groupBy("bucket").agg(F.sum("n_target").alias("n_target"), F.sum("n_raw").alias("n_raw"))


def log_ratios(counts: list[tuple[int, int, int]], smoothing: float = 1.0) -> np.ndarray:
    """Log of the ratio of a bucket's smoothed probability in target text to that in raw text."""
    table = np.zeros((2, BUCKETS))
    for bucket, target, raw in counts:
        table[:, bucket] = target, raw
    shares = (table + smoothing) / (table.sum(axis=1, keepdims=True) + smoothing * BUCKETS)
    return np.log(shares[0] / shares[1])


def target_ids(labels: DataFrame, sample: int) -> set:
    """Ids of ``sample`` documents labelled 1, and never lower, at most: those with the lowest hashes."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return {r[0] for r in good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}


def importance_weights(docs: DataFrame, labels: DataFrame, *, sample: int = 50_000) -> Callable[[DataFrame], DataFrame]:
    """How to weigh documents: a function that adds ``log_weight``, ``n_grams`` and ``target`` to rows of ``docs``.

    ``labels`` (``doc_id``, ``quality``) names the target text: documents labelled 1, ``sample`` of them at
    most, whose ids go to every task, so texts never meet labels in a shuffle. The raw model counts
    all rows of ``docs``. Each model has ``BUCKETS`` entries. A weight is the sum of the log ratios
    of a text's n-grams: 0 for null and empty texts and those of blanks. Where a document has
    several labels the lowest counts; null labels do not. Columns of these names are replaced.
    """
    context = docs.sparkSession.sparkContext
    ids = context.broadcast(target_ids(labels, sample))
    ratios = context.broadcast(log_ratios([tuple(r) for r in _gram_counts(docs.select("doc_id", F.col("text").cast("binary").alias("bytes")), ids).collect()]))

    def weigh(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("log_weight", "n_grams", "target")]
        at = [kept.index("doc_id"), kept.index("text")]

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, good, hashes = ratios.value, ids.value, _Hashes()
            for batch in batches:
                total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for i, text in enumerate(batch.column(at[1])):
                    for found in grams(_bytes(text), hashes):
                        total[i] += weights[found].sum()
                        n[i] += len(found)
                target = [i in good for i in batch.column(at[0]).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(total), pa.array(n), pa.array(target, pa.bool_())], [*kept, "log_weight", "n_grams", "target"]
                )

        fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
        return rows.select(*kept).mapInArrow(of, f"{fields}, log_weight double, n_grams long, target boolean")

    return weigh


def _uniform(seed: int) -> F.Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11).cast("double") + 0.5) / float(1 << 53)


def kth_largest(df: DataFrame, key: str, k: int) -> float | None:
    """The ``k``-th largest value of ``key`` by narrowing a range of it; None if there are fewer rows.

    Each round counts the rows in 1,000 cells of the range and goes on in the cell that holds the
    k-th, so no row leaves its task, whatever ``k``.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or n < k:
        return None
    above = 0
    while low < high:
        width = (high - low) / 1000
        if low + width <= low:
            break
        inside = df.where((F.col(key) >= low) & (F.col(key) <= high))
        cell = F.least(F.floor((F.col(key) - low) / width), F.lit(999))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for _, n, cell_low, cell_high in sorted(map(tuple, cells.collect()), reverse=True):
            if above + n >= k:
                low, high = cell_low, cell_high
                break
            above += n
    return low


def gumbel_keys(weighted: DataFrame, seed: int) -> DataFrame:
    """Add ``gumbel_key``: log weight plus Gumbel noise that hashes doc_id and text."""
    return weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(_uniform(seed))))


def gumbel_bound(keyed: DataFrame, *, keep: int | None = None, recall: float = 0.998) -> float | None:
    """The ``keep``-th largest key; null if all rows are kept.

    ``keep`` is, unless given, the number of rows that weigh at least what ``recall`` of the target
    rows weigh. Without target rows nothing is rejected.
    """
    if keep is None:
        target = keyed.where("target")
        least = kth_largest(target, "log_weight", max(1, int(np.ceil(recall * target.count()))))
        keep = keyed.count() if least is None else keyed.where(F.col("log_weight") >= least).count()
    bound = kth_largest(keyed, "gumbel_key", keep)
    return float("inf") if bound is None and keep <= 0 else bound


def _selected(bound: float | None) -> F.Column:
    return F.lit(True) if bound is None else F.col("gumbel_key") >= bound


def resample(docs: DataFrame, labels: DataFrame, *, keep: int | None = None, recall: float = 0.998, sample: int = 50_000, seed: int = 0) -> DataFrame:
    """``doc_id``, ``log_weight``, ``n_grams``, ``gumbel_key`` and ``selected`` of every row of ``docs``.

    The rows of the ``keep`` largest Gumbel keys are selected, which draws them without replacement in
    proportion to their importance weights; rows at the last key drawn all are. Reruns agree, and
    repeated rows are drawn together. Other columns are ignored.
    """
    texts = docs.select("doc_id", "text")
    weighted = importance_weights(texts, labels, sample=sample)(texts)
    keyed = written(gumbel_keys(weighted.withColumn("text_hash", F.xxhash64("text")), seed).drop("text", "text_hash"))
    return keyed.withColumn("selected", _selected(gumbel_bound(keyed, keep=keep, recall=recall))).drop("target")


def select_quality(docs: DataFrame, labels: DataFrame, *, keep: int | None = None, recall: float = 0.998, sample: int = 50_000, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, with their columns.

    Rows are weighed again where they lie, rather than sent to meet what was decided for them.
    """
    texts = docs.select("doc_id", "text")
    weigh = importance_weights(texts, labels, sample=sample)
    keyed = written(gumbel_keys(weigh(texts).withColumn("text_hash", F.xxhash64("text")), seed).drop("text", "text_hash"))
    bound = gumbel_bound(keyed, keep=keep, recall=recall)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    again = weigh(docs.withColumnsRenamed(names)).withColumn("text_hash", F.xxhash64("text"))
    return gumbel_keys(again, seed).where(_selected(bound)).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])

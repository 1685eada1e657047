"""Removal of long byte strings that occur twice or more in a corpus, by suffix sorting of what may repeat.

Any string of ``length`` bytes contains the same grams wherever it occurs, so the smallest hash among
its grams names it. Starts whose strings share that name and follow each other form a piece. Pieces
with a name of their own cannot repeat; pieces of one name that are all equal, repeat as they are; the
others, where texts part, are suffix-sorted together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import written
from leadtime.llm.suffixes import repeated_starts
from leadtime.session import cut_lineage

GRAM = 32
#: Bytes hashed at once, and bytes suffix-sorted at once (a group of pieces stays whole).
CHUNK = 1 << 21
BLOCK = 1 << 18
#: Different pieces of one name that are sorted together; beyond, they are cut finer first.
CROWD = 1024
#: And bytes of them: sorting takes some hundred bytes for a byte of text.
CROWD_BYTES = 1 << 22
#: Rows that a task holds before it hands them on.
HELD = 10_000
#: Starts to a piece at the finer levels; one start to a piece leaves nothing to sort.
FINER = (48, 8, 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every place, built by doubling."""
    hashes, step, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        hashes = hashes[:-step] * np.uint64(base) + hashes[step:]
        step, base = step * 2, base * base % (1 << 64)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def cut_pieces(data: np.ndarray, sizes: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, name, and whether the name occurs twice in the piece, for texts laid end to end.

    Every text has ``length`` bytes at least; strings that cross from text to text are left out.
    """
    width = length - GRAM + 1
    hashes = gram_hashes(data)
    names = _sliding(hashes, width, np.minimum)
    ends = np.cumsum(sizes)
    valid = np.zeros(len(names), bool)
    for end, size in zip(ends, sizes):
        valid[end - size : end - length + 1] = True
    changes = np.flatnonzero(names[1:] != names[:-1]) + 1
    edge = np.zeros(len(names) + 1, bool)
    edge[changes] = True
    edge[1:-1] |= valid[1:] != valid[:-1]
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:] - 1
    kept = valid[first]
    first, last = first[kept], last[kept]
    name = names[first]
    # Places of grams that name some string; more of them than pieces means that a piece has two.
    low = np.where(valid, names, np.uint64(0))
    edge_pad = np.zeros(width - 1, np.uint64)
    highest = _sliding(np.concatenate([edge_pad, low, edge_pad]), width, np.maximum)
    places = np.flatnonzero(highest[: len(hashes)] == hashes)
    twice = np.zeros(len(first), bool)
    if len(places) != len(first) and len(first):
        piece = np.searchsorted(first, places, side="right") - 1
        for _ in range(width):
            wrong = (piece >= 0) & (name[piece] != hashes[places])
            if not wrong.any():
                break
            piece[wrong] -= 1
        twice = np.bincount(piece[piece >= 0], minlength=len(first))[: len(first)] > 1
    return first, last, name, twice


def _slices(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in stretches that overlap so that every string lies whole in one of them."""
    for start in range(0, len(text) - length + 1, CHUNK):
        yield start, text[start : start + CHUNK + length - 1]


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``start``, ``starts``, ``name``, ``content`` and ``twice`` of the pieces of all texts."""

    def flush(rows: list[tuple[object, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        joined = b"".join(r[3] for r in rows)
        sizes = [len(r[3]) for r in rows]
        first, last, name, twice = cut_pieces(np.frombuffer(joined, np.uint8), sizes, length)
        view = memoryview(joined)
        content = np.fromiter(
            (xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first)
        )
        begins = np.cumsum([0, *sizes[:-1]])
        row = np.searchsorted(begins, first, side="right") - 1
        bases = np.array([r[2] for r in rows])
        ids = pa.array([r[0] for r in rows], id_type)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(row)),
                pa.array(np.array([r[1] for r in rows])[row]),
                pa.array(first - begins[row] + bases[row]),
                pa.array((last - first + 1).astype(np.int32)),
                pa.array(name.view(np.int64)),
                pa.array(content.view(np.int64)),
                pa.array(twice),
            ],
            ["doc_id", "text_hash", "start", "starts", "name", "content", "twice"],
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        held, size = [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for base, stretch in _slices(text.as_py(), length):
                    held.append((doc_id, text_hash, base, stretch))
                    size += len(stretch)
                    if size >= CHUNK:
                        yield from flush(held)
                        held, size = [], 0
        yield from flush(held)

    id_type = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, start long, starts int, name long, content long, twice boolean"
    return docs.where(F.length("bytes") >= length).mapInArrow(of, schema)


def _texts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Text of each different (``name``, ``content``) of ``wanted``, with the number ``n`` of its places.

    Equal rows have equal cuts; as a set these are no more than one row's, and each row counts them once.
    """
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "starts", "name", "content", "twice")).alias("cuts"))
    joined = _keyed_join(docs, lists, "inner").select("bytes", "cuts")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                for c in cuts.as_py():
                    rows.append((c["name"], c["content"], c["twice"], text[c["start"] : c["start"] + c["starts"] + length - 1]))
                    if len(rows) >= HELD:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        name, content, twice, text = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(name, pa.int64()), pa.array(content, pa.int64()), pa.array(twice, pa.bool_()), pa.array(text, pa.binary())],
            ["name", "content", "twice", "text"],
        )

    cut = joined.mapInArrow(of, "name long, content long, twice boolean, text binary")
    return cut.groupBy("name", "content").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.first("text").alias("text"))


def _keyed_join(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return docs.join(other, (docs["text_hash"] == other["__hash"]) & docs["doc_id"].eqNullSafe(other["__id"]), how).drop("__id", "__hash")


def _sorted_marks(kinds: DataFrame, length: int) -> DataFrame:
    """Runs ``low`` to ``high`` of starts in each piece whose strings repeat among the pieces of its name."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        begins = np.concatenate([[0], sizes.cumsum()])
        valid = np.zeros(len(data), bool)
        for begin, size in zip(begins, sizes):
            valid[begin : begin + size - length + 1] = True
        found = repeated_starts(data, valid, length)
        for begin, row in zip(begins, rows):
            if row[2] > 1:
                found[begin : begin + len(row[3]) - length + 1] = True
        step = np.diff(found.astype(np.int8), prepend=0, append=0)
        low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
        row = np.searchsorted(begins, low, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([r[0] for r in rows], np.int64)[row]),
                pa.array(np.array([r[1] for r in rows], np.int64)[row]),
                pa.array(low - begins[row]),
                pa.array(high - begins[row]),
            ],
            ["name", "content", "low", "high"],
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if size >= BLOCK and row[0] != last:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield from solve(held)

    together = kinds.select("name", "content", "n", "text").repartition("name").sortWithinPartitions("name")
    return together.mapInArrow(of, "name long, content long, low long, high long")


def _finer(kinds: DataFrame, length: int, starts: int) -> DataFrame:
    """Pieces cut by the distance from a start to its naming gram, ``starts`` distances to a piece.

    All strings of such a piece hold the same middle, which names it, wherever they occur.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, owned, gram, n, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                hashes = gram_hashes(np.frombuffer(text, np.uint8)).view(np.int64)
                places = np.flatnonzero(hashes == gram)
                begin = np.arange(len(text) - length + 1)
                place = places[np.searchsorted(places, begin)]
                step = (place - begin) // starts
                edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(step) != 0)) + 1
                for a, b in zip([0, *edges], [*edges, len(begin)]):
                    middle = int(place[a] - step[a] * starts)
                    name = xxhash.xxh3_64_intdigest(text[middle : middle - starts + 1 + length], seed=int(step[a]) + (starts << 32))
                    part = text[a : b + length - 1]
                    rows.append((_signed(name), _signed(xxhash.xxh3_64_intdigest(part, seed=1)), gram, owner, owned, int(a), n, part))
                    if len(rows) >= HELD:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = ["name", "content", "gram", "owner", "owned", "at", "n", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "name long, content long, gram long, owner long, owned long, at long, n long, text binary"
    return kinds.select("name", "content", "gram", "n", "text").mapInArrow(of, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marks(kinds: DataFrame, length: int, finer: tuple[int, ...] = FINER) -> DataFrame:
    """``name``, ``content``, ``low``, ``high``: which starts of each different piece repeat.

    Names with up to ``CROWD`` different pieces of ``CROWD_BYTES`` in all are suffix-sorted. Beyond that
    the pieces are cut finer, which parts those that share no more than the gram; equal ones are folded
    and the same is done to them. Where a piece holds one string, its equals are all there is to find.
    """
    sized = kinds.groupBy("name").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("places"), F.max("twice").alias("twice"), F.sum(F.length("text")).alias("bytes")
    )
    names = cut_lineage(sized.where("places > 1 or twice"))
    alike = kinds.join(names.where("kinds = 1 and not twice").select("name"), "name", "left_semi")
    found = alike.select("name", "content", F.lit(0).cast("long").alias("low"), (F.length("text") - length).cast("long").alias("high"))
    large = (F.col("kinds") > CROWD) | ((F.col("bytes") > CROWD_BYTES) & F.lit(bool(finer)))
    parting = names.where("kinds > 1 or twice")
    some = parting.where(~large).select("name")
    found = found.union(_sorted_marks(kinds.join(some, "name", "left_semi"), length))
    crowded = parting.where(large).select("name")
    if not finer or crowded.isEmpty():
        return found
    parts = written(_finer(kinds.join(crowded, "name", "left_semi"), length, finer[0]))
    folded = parts.groupBy("name", "content").agg(F.sum("n").alias("n"), F.first("gram").alias("gram"), F.first("text").alias("text"))
    inner = _marks(written(folded.withColumn("twice", F.lit(False))), length, finer[1:])
    return found.union(
        parts.select("name", "content", "owner", "owned", "at").join(inner, ["name", "content"]).select(
            F.col("owner").alias("name"), F.col("owned").alias("content"), (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")
        )
    )


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``runs``, first and last start of runs of repeated strings, of texts that have any.

    Equal rows have equal runs, which a set holds once.
    """
    all_pieces = written(pieces(docs, length))
    names = all_pieces.groupBy("name").agg(
        F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most"), F.max("twice").alias("repeats")
    )
    names = names.where("n > 1 or repeats").select("name", ((F.col("least") == F.col("most")) & ~F.col("repeats")).alias("alike"))
    met = written(all_pieces.join(names, "name"))
    alike = met.where("alike").select("doc_id", "text_hash", F.col("start").alias("low"), (F.col("start") + F.col("starts") - 1).alias("high"))
    parting = met.where("not alike")
    kinds = written(_texts(parting, docs, length).withColumn("gram", F.col("name")))
    marks = _marks(kinds, length)
    marked = parting.join(marks, ["name", "content"]).select(
        "doc_id", "text_hash", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    )
    return alike.union(marked).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("runs"))


def _merged(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the strings of the runs, as maximal spans."""
    spans: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"] + length) for r in runs or ()):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [tuple(s) for s in spans]


def _without(text: bytes, spans: list[tuple[int, int]], whole_characters: bool) -> bytes:
    at, kept = 0, []
    for low, high in spans:
        if whole_characters:
            while low < high and text[low] & 0xC0 == 0x80:
                low += 1
            while high > low and high < len(text) and text[high] & 0xC0 == 0x80:
                high -= 1
        kept.append(text[at:low])
        at = high
    return b"".join([*kept, text[at:]])


def remove_repeated(docs: DataFrame, *, length: int = 200, count: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its text freed of strings of ``length`` bytes that start anywhere else too.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``spans``,
    ``kept_sha256`` of the remaining bytes, and the columns of ``docs`` of other names with ``text`` replaced
    by the remaining text; there, a character is removed only if all its bytes are. Every copy is
    removed, the first too, and strings are judged on the texts as they came. Strings never cross
    texts. Null and empty texts have nothing to remove and stay as they are. A row and its repetition
    are two places; rows are told apart by doc_id, which may be null, and text. The column ``count``, if
    there, becomes the number of characters that remain.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    runs = repeated_runs(keyed, length)
    names = ["text", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    others = [c for c in docs.columns if c not in ("doc_id", *names)]
    full = docs.select("doc_id", F.xxhash64("text").alias("__own"), F.col("text").cast("binary").alias("__bytes"), *others)
    found = runs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("runs").alias("__runs"))
    same = (full["__own"] == found["__hash"]) & full["doc_id"].eqNullSafe(found["__id"])
    joined = full.join(found, same, "left").select("__bytes", "__runs", "doc_id", *others)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(0), batch.column(1)):
                given = text.as_py()
                text, spans = given or b"", _merged(runs.as_py(), length)
                kept = _without(text, spans, False)
                shown = None if given is None else _without(text, spans, True).decode("utf-8", "replace")
                rows.append((shown, len(text), len(text) - len(kept), len(spans), [{"low": a, "high": b} for a, b in spans], hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 6
            span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), span, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(columns, kinds)], *batch.columns[2:]], [*names, "doc_id", *others]
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", *others])
    schema = f"text string, n_bytes long, n_removed long, n_spans long, spans array<struct<low: bigint, high: bigint>>, kept_sha256 string, {fields}"
    freed = joined.mapInArrow(of, schema)
    return freed.withColumn(count, F.length("text").cast(docs.schema[count].dataType)) if count in docs.columns else freed

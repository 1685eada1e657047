"""Best-fit packing of token sequences: linear grouping, configurations of few sizes, then best fit for the small."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtime.llm.common import BLANKS, number_rows, text_pieces, written

#: Letters or marks of words whose ids a Python worker remembers; a full memory is emptied.
REMEMBERED = 400_000
#: Bytes of text that are tokenized together.
AT_ONCE = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


class WordIds:
    """Ids of blank-separated words by a word-level BPE tokenizer, as little-endian 32-bit bytes.

    The tokenizer drops blanks and works on each word by itself, so ids of a text are those of its
    words in turn. Plain lower-case Latin words with trailing marks go straight to the tokenizer's
    model, letters and marks apart, so a word before a full stop costs no second tokenization; everything else passes
    through all of the tokenizer.
    """

    PLAIN = re.compile("([a-zß-öø-ÿ]+)?([!-&(-/:;=-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        # Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            ids = self.parts[part] = self._packed([t.id for t in self.tokenizer.model.tokenize(letters)])
        return ids

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = self.PLAIN.fullmatch(text if text.isascii() else text.lower())
        if plain is None:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        letters, marks = plain.groups("")
        return (self._part(letters) if letters else b"") + (self._part(marks) if marks else b"")

    def of(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each of some texts, together.

        Words are found and told apart in bulk, so that each distinct one is looked up once. The tokenizer
        ignores case; A-Z are lowered at once so that fewer words differ.
        """
        data = np.frombuffer((b" " + b" ".join(texts) + b" ").lower(), np.uint8)
        blank = _BLANK[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~blank])]).dictionary_encode()
        known = list(map(self._ids, words.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        tokens, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        code = words.indices.to_numpy()
        counts = sizes[code]
        after = np.concatenate([[0], np.cumsum(counts)])
        found = tokens[np.arange(after[-1]) + np.repeat(first[code] - after[:-1], counts)]
        # A text begins after the blank that ends the one before.
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        cuts = after[np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))]
        return [found[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]


_LOADED: dict[str, WordIds] = {}


class _Cutter:
    """Start, length and checksum of each piece of one text's ids and the end id, from its ids in runs."""

    def __init__(self, capacity: int, end_id: int):
        self.capacity, self.end = capacity, np.array([end_id], "<u4").tobytes()
        self.start, self.rest = 0, b""

    def add(self, run: bytes) -> list[tuple[int, int, int]]:
        """The pieces that are full and not the last."""
        data, size, at, found = self.rest + run, 4 * self.capacity, 0, []
        while len(data) - at > size:
            found.append((self.start, self.capacity, zlib.crc32(data[at : at + size])))
            self.start, at = self.start + self.capacity, at + size
        self.rest = data[at:]
        return found

    def finish(self) -> list[tuple[int, int, int]]:
        found = self.add(self.end)
        return [*found, (self.start, len(self.rest) // 4, zlib.crc32(self.rest))]


def _pieces(texts: Iterable[bytes], ids: WordIds, capacity: int, end_id: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, number, start, length and checksum of every piece; texts, or parts of long ones, are tokenized some at a time."""
    cutter, number, row = _Cutter(capacity, end_id), 0, 0

    def run_of(some: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal cutter, number, row
        for at, run in zip((r for r, _ in some), ids.of([part for _, part in some])):
            while row < at:
                for cut in cutter.finish():
                    yield row, number, *cut
                    number += 1
                cutter, number, row = _Cutter(capacity, end_id), 0, row + 1
            for cut in cutter.add(run):
                yield row, number, *cut
                number += 1

    held, size, at = [], 0, -1
    for at, text in enumerate(texts):
        for part in text_pieces(text):
            held.append((at, part))
            size += len(part)
            if size >= AT_ONCE:
                yield from run_of(held)
                held, size = [], 0
    if held:
        yield from run_of(held)
    if at >= 0:
        for cut in cutter.finish():
            yield row, number, *cut
            number += 1


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece of every row of ``docs``.

    A row's ids are its text's, then ``end_id``; null and empty texts have that one. Rows of more
    than ``capacity`` ids are cut into pieces of ``capacity``, the last one shorter if need be.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            rows = list(_pieces((text.as_py() or b"" for text in batch.column(1)), ids, capacity, end_id))
            of_row, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of_row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(of, schema)


@dataclass
class Plan:
    """Where the n-th item of a class goes, as runs: the run from ``first`` on starts at ``target``,
    ``each`` items to a target, at ``slot``; for small items ``room`` is the class of the target."""

    runs: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)
    targets: int = 0

    def add(self, of: int, first: int, target: int, each: int, slot: int, room: int = 0) -> None:
        self.runs.setdefault(of, []).append((first, target, each, slot, room))

    def look_up(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros((3, len(ranks)), np.int64)
        for of in np.unique(classes):
            first, target, each, slot, room = np.array(self.runs[int(of)], np.int64).T
            rows = np.flatnonzero(classes == of)
            run = np.searchsorted(first, ranks[rows], side="right") - 1
            past = ranks[rows] - first[run]
            out[:, rows] = target[run] + past // each[run], slot[run] + past % each[run], room[run]
        return out[0], out[1], out[2]


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int, int]]:
    """Lengths in about ``groups`` classes of equal number, from the longest down: (longest, shortest, number).

    Items of a class are planned as if all were its longest.
    """
    total, found = sum(counts.values()), []
    share, left = max(1, total / groups), 0
    for length in sorted(counts, reverse=True):
        if not found or left + counts[length] / 2 > share:
            found.append([length, length, 0])
            left = 0
        found[-1][1] = length
        found[-1][2] += counts[length]
        left += counts[length]
    return [tuple(g) for g in found]


def fullest(sizes: Sequence[int], left: Sequence[int], room: int) -> list[tuple[int, int]]:
    """Classes and how many of each fill ``room`` best, by sums that can be reached, one bit each."""
    usable = [g for g in range(len(sizes)) if left[g] and sizes[g] <= room]
    mask, reach, history = (1 << (room + 1)) - 1, 1, []
    for g in usable:
        history.append(reach)
        for _ in range(min(left[g], room // sizes[g])):
            wider = reach | (reach << sizes[g]) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for g, before in zip(usable[: len(history)][::-1], history[::-1]):
        n = 0
        while not before >> total & 1:
            total -= sizes[g]
            n += 1
        if n:
            chosen.append((g, n))
    return chosen


def plan_large(groups: Sequence[tuple[int, int, int]], capacity: int) -> Plan:
    """Configurations of class sizes, each used as often as its classes allow; items fill their slots in turn.

    The largest class left is always served, with the fullest completion, so the configurations are
    about as few as the classes.
    """
    plan, sizes, left = Plan(), [g[0] for g in groups], [g[2] for g in groups]
    used = [0] * len(groups)
    for g in range(len(groups)):
        while left[g]:
            left[g] -= 1
            chosen = dict(fullest(sizes, left, capacity - sizes[g]))
            left[g] += 1
            chosen[g] = chosen.get(g, 0) + 1
            times = min(left[c] // n for c, n in chosen.items())
            slot = 0
            for c, n in sorted(chosen.items()):
                plan.add(c, used[c], plan.targets, n, slot)
                used[c] += n * times
                left[c] -= n * times
                slot += n
            plan.targets += times
    return plan


def plan_small(counts: dict[int, int], rooms: dict[int, int], capacity: int) -> Plan:
    """Best fit for items by length, longest first, over sequences known by their room only.

    Sequences of equal room and history are one batch (room at first, number there, count); a step
    puts items of one length into a batch of the least room that holds them. ``room`` of a run is
    the batch's first one, ``capacity`` for new sequences.
    """
    plan, opened = Plan(), 0
    held: dict[int, list[tuple[int, int, int, int]]] = {r: [(r, 0, n, 0)] for r, n in rooms.items() if r > 0}
    levels = sorted(held)
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            at = bisect_left(levels, length)
            if at == len(levels):
                more = -(-(n - done) // (capacity // length))
                batch, level = (capacity, opened, more, 0), capacity
                opened += more
            else:
                level = levels[at]
                batch = held[level].pop()
                if not held[level]:
                    del held[level]
                    levels.pop(at)
            room, first, size, depth = batch
            some = min(size, n - done)
            plan.add(length, done, first, 1, depth, room)
            done += some
            for where, part in ((level - length, (room, first, some, depth + 1)), (level, (room, first + some, size - some, depth))):
                if where and part[2]:
                    if where not in held:
                        held[where] = []
                        levels.insert(bisect_left(levels, where), where)
                    held[where].append(part)
    plan.targets = opened
    return plan


def _counts(df: DataFrame, column: str) -> dict[int, int]:
    """Rows by a value between 0 and the capacity: as many rows as that on the driver at most."""
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def _assigned(df: DataFrame, plan: Plan) -> DataFrame:
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            target, slot, room = plan.look_up(frame["class"].to_numpy(), frame["first"].to_numpy())
            yield frame.drop(columns=["class", "first"]).assign(target=target, slot=slot, room=room)

    names = [f for f in df.schema.fields if f.name not in ("class", "first")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in names], "target long, slot long, room long"])
    return df.mapInPandas(of, schema)


def pack(pieces: DataFrame, *, capacity: int = 4096, small: int = 128, groups: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``length`` from 1 to ``capacity``).

    Only numbers of pieces by length reach the driver, ``capacity`` of them at most, so the plan is as
    small for any table. Pieces above ``small`` are grouped linearly; configurations of groups become
    sequences, and the n-th piece of a group takes the group's n-th slot, which is at least as long.
    The room so left, and by rounding, is counted; smaller pieces go by best fit to the n-th
    sequence of a room. A window over a sequence, ``capacity`` pieces at most, gives the offsets.
    Repeated pieces are packed each; an empty table gives none.
    """
    columns = pieces.columns
    one = pieces.withColumn("__one", F.lit(1).cast("long"))
    counts = _counts(pieces, "length")
    classes = linear_groups({n: c for n, c in counts.items() if n > small}, groups)
    large_plan = plan_large(classes, capacity)
    class_of = np.zeros(capacity, np.int64)
    for n, (longest, shortest, _) in enumerate(classes):
        class_of[shortest - 1 : longest] = n
    of_group = F.element_at(F.lit(class_of), F.col("length").cast("int"))
    order = [c for c in columns if c != "length"]

    numbered = number_rows(one.where(F.col("length") > small).withColumn("class", of_group), ["class"], order, copies="__one")
    large = written(_assigned(numbered.drop("__one"), large_plan).withColumnRenamed("target", "sequence_id").drop("room"))

    rooms = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms = rooms.withColumn("__one", F.lit(1).cast("long"))
    small_plan = plan_small({n: c for n, c in counts.items() if n <= small}, _counts(rooms, "room"), capacity)
    places = number_rows(rooms, ["room"], ["sequence_id"], copies="__one").select(
        F.col("room"), F.col("first").alias("target"), "sequence_id"
    )
    numbered = number_rows(one.where(F.col("length") <= small).withColumn("class", F.col("length")), ["class"], order, copies="__one")
    filled = _assigned(numbered.drop("__one"), small_plan)
    filled = (
        filled.join(places, ["room", "target"], "left")
        .withColumn("sequence_id", F.coalesce("sequence_id", F.col("target") + large_plan.targets))
        .withColumn("slot", F.col("slot") + capacity)
    )
    whole = large.select(*columns, "sequence_id", "slot").union(filled.select(*columns, "sequence_id", "slot"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("slot")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, **options) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and place: ``token_pieces``, then ``pack``."""
    return pack(written(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id)), capacity=capacity, **options)

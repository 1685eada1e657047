"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import in_blocks, text_pieces, unfolded, written
from leadtime.llm.components import connected_components, least_tied
from leadtime.session import cut_lineage

BITS = 64
SEED = 42
#: Fingerprints that share a block in such number are linked through their one-bit variants, not pair by pair.
CROWD = 24
#: Texts of so few shingles, where majorities tie often, also share a block by any of their least shingles.
SHORT = 25
#: Texts of a candidate group that are compared by their shingles at a time, and their bytes.
COMPARED = 256
COMPARED_BYTES = 16 << 20


def fingerprint(text: bytes | None, width: int) -> int:
    """Majority of the bits of the shingles' hashes; 0 for a text without words."""
    ones, n, rest = np.zeros(BITS, np.int64), 0, []
    for piece in text_pieces((text or b"").lower()):
        words = rest + piece.split()
        shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(width)))]
        if not shingles:
            rest = words
            continue
        rest = words[len(words) - width + 1 :]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
        for start in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n and rest:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(rest), SEED)], "<u8")
        ones, n = np.unpackbits(hashes.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the 64-bit SimHash over word shingles of the lower-cased text, repeats included."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(of, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _choices(distance: int, blocks: int) -> list[list[int]]:
    """The sets of bits that may be equal: any ``blocks - distance`` of the blocks."""
    size = BITS // blocks
    cuts = [range(i * size, BITS if i == blocks - 1 else (i + 1) * size) for i in range(blocks)]
    return [[b for block in some for b in block] for some in combinations(cuts, blocks - distance)]


def fingerprint_links(fps: DataFrame, *, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints at ``distance`` or fewer bits, and no others.

    ``fps`` holds distinct values in ``fp``. A pair that close agrees in at least ``blocks - distance``
    of the blocks, so the fingerprints are joined on every such choice of blocks and the Hamming
    distance is verified. Where more than ``CROWD`` values agree in a choice (a large group of near
    copies), pairs would grow with the square of their number. There each value is keyed instead by
    itself with up to ``ceil(distance / 2)`` of the remaining bits flipped: values within the
    distance meet in a key. Every value is linked to the smallest of its key if that is within the
    distance; for an even distance it always is, so the values' components are the same.
    """
    if distance % 2:
        raise ValueError("the crowded blocks need an even distance")
    choices = _choices(distance, blocks)
    masks = [_signed(sum(1 << b for b in bits)) for bits in choices]
    flips = [
        [_signed(sum(1 << b for b in some)) for n in range(distance // 2 + 1) for some in combinations([b for b in range(BITS) if b not in bits], n)]
        for bits in choices
    ]
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.choice", "k.block")
    shared = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(keyed.join(shared, ["choice", "block"]))
    few = met.where(F.col("n") <= CROWD)
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    pairs = (
        few.alias("x")
        .join(
            few.alias("y"),
            (F.col("x.choice") == F.col("y.choice"))
            & (F.col("x.block") == F.col("y.block"))
            & (F.col("x.fp") < F.col("y.fp"))
            & (apart(F.col("x.fp"), F.col("y.fp")) <= distance),
        )
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    variants = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in flips]), F.col("choice") + 1)
    many = met.where(F.col("n") > CROWD).select("choice", "block", "fp", F.explode(variants).alias("flip"))
    many = many.select("choice", "block", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    lowest = many.groupBy("choice", "block", "variant").agg(F.min("fp").alias("b"), F.max("fp").alias("__top")).where("b < __top")
    stars = many.join(lowest, ["choice", "block", "variant"]).select(F.col("fp").alias("a"), "b")
    stars = stars.where((F.col("a") != F.col("b")) & (apart(F.col("a"), F.col("b")) <= distance))
    return pairs.union(stars).distinct()


def simhash_groups(docs: DataFrame, *, width: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest doc_id that links of fingerprints at ``distance`` or fewer bits
    reach. Texts with no word, null ones too, have fingerprint 0 and are linked like any other.
    Equal texts and repeated rows share a fingerprint and are folded into one value before any join.
    A null doc_id keeps its row and is never the smallest unless the group has no other. An empty
    table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, width=width))
    fps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(fps, distance=distance, blocks=blocks))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def differing_share(similarity: float) -> float:
    """Share of bits in which SimHashes of shingle sets of this Jaccard similarity differ, on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def wide_groups(
    docs: DataFrame, *, width: int = 5, similarity: float = 0.8, words: int = 4, recall: float = 0.99, seed: int = 5
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``similar_id``: for near copies by shingle ``similarity``, the smallest doc_id of the group.

    Two bits of 64 tell nearly equal texts; a similarity of 0.8 turns about one bit in seven, so here
    fingerprints have ``words`` times 64 bits. They only name candidates: pairs that share a block and
    differ in no more bits than 0.995 of the pairs at ``similarity`` do. No deal of so many turned
    bits over blocks leaves a long block whole for certain: blocks are sets of bits drawn at random,
    of a size at which about four unlike texts share one, and as many that a pair at ``similarity``
    shares one with probability ``recall``. Texts of ``SHORT`` shingles at most, and those that can be similar to
    one, also share a block by any of their least hashed shingles, so many that a pair at ``similarity`` has one in common.
    Blocks of more than ``CROWD`` are compared in pieces, each of which ties its texts to the least
    one found, and pieces to each other by those. Within a group that candidates connect, shingle sets are
    then compared (``near_links``), and only pairs at ``similarity`` or above (Jaccard, shingles by 64-bit hash) are linked.

    A document is a doc_id with a text: rows that repeat both are one, other texts of a doc_id are documents of their
    own. Texts without a word link with nothing, and rows without a doc_id are left out.
    """
    bits = BITS * words
    # Ties of few shingles turn more bits: at 0.8 under 0.7 of 100 more from 20 shingles on, up to a quarter more below.
    share, short_share = differing_share(similarity) + 0.007, 1.25 * differing_share(similarity)
    limit, short_limit = (int((s + 2.576 * sqrt(s * (1 - s) / bits)) * bits) for s in (share, short_share))
    known = docs.where(F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(2)):
                found = shingle_set(text.as_py(), width)
                if len(found):
                    # Equal sets share the second part of the print; few shingles may turn no bit of the first.
                    name = wide_fingerprint(found, words) + xxhash.xxh3_128_digest(found.tobytes())
                    least = found[: len(found) - ceil(similarity * len(found) - 1e-9) + 1] if len(found) <= SHORT / similarity else found[:0]
                    rows.append((i, name, least.view(np.int64)))
            at, names_, least = zip(*rows) if rows else ((),) * 3
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(names_, pa.binary()), pa.array(least, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "fp", "least"],
            )

    texts = known.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    prints = written(texts.mapInArrow(of, f"doc_id {kind}, text_hash long, fp binary, least array<bigint>"))
    named = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    fps = written(prints.groupBy("fp").agg(F.min(named).alias("node"), F.min("least").alias("least")).select("fp", "node", "least"))
    node_kind = f"struct<id:{kind},hash:bigint>"
    block_bits = max(8, int(log2(max(fps.count(), 1))) - 1)
    together = (1 - share) ** block_bits
    blocks = ceil(log(1 - recall) / log(1 - together))
    chosen = np.stack([np.random.default_rng([seed, i]).choice(bits, block_bits, replace=False) for i in range(blocks)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(fp[: bits // 8] for fp in batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, bits // 8)
            ones = np.unpackbits(raw, axis=1, bitorder="little")
            found = np.stack([ones[:, some] @ (1 << np.arange(block_bits, dtype=np.int64)) for some in chosen], axis=1)
            lists = pa.array([np.concatenate([f, np.array(s, np.int64)]) for f, s in zip(found, batch.column(2).to_pylist())], pa.list_(pa.int64()))
            parts = [pa.array(np.ascontiguousarray(part)) for part in raw.view("<i8").T]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *parts], ["node", "keys", *names])

    names = [f"w{i}" for i in range(words)]
    coded = fps.select("node", "fp", "least").mapInArrow(keys, f"node {node_kind}, keys array<bigint>, " + ", ".join(f"{n} long" for n in names))
    # All least shingles of short texts are one choice, the last.
    placed = coded.select("node", *names, F.posexplode("keys").alias("choice", "block")).withColumn("choice", F.least("choice", F.lit(blocks)))
    shared = placed.groupBy("choice", "block").agg(F.count("*").alias("held")).where("held > 1")
    met = placed.join(unfolded(shared), ["choice", "block"])
    few, many = met.where(F.col("held") <= CROWD), met.where(F.col("held") > CROWD).drop("held")
    x, y = few.alias("x"), few.alias("y")
    apart = sum((F.bit_count(F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}"))) for n in names), F.lit(0))
    most = F.when(F.col("x.choice") == blocks, short_limit).otherwise(limit)
    pairs = x.join(
        unfolded(y),
        (F.col("x.choice") == F.col("y.choice")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.node") < F.col("y.node")) & (apart <= most),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def tie(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("hash", "ascending")]).combine_chunks()
        own = table["own"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        prints = np.stack([table[n].to_numpy().view(np.uint64) for n in names], axis=1)
        most = short_limit if table["choice"][0].as_py() == blocks else limit

        def close(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.nonzero(sum(np.bitwise_count(prints[left, i][:, None] ^ prints[right, i][None, :]).astype(np.int16) for i in range(words)) <= most)
            return left[a], right[b]

        # Each block by itself; two blocks are then tied by the least texts of their parts alone.
        root = np.arange(len(own))
        for block in {low, high}:
            inside = np.flatnonzero(own == block)
            root = np.minimum(root, least_tied(len(own), *close(inside, inside)))
        if low != high:
            a, b = close(np.flatnonzero(own == low), np.flatnonzero(own == high))
            tied_to = least_tied(len(own), root[a], root[b])
            tied = np.flatnonzero(tied_to != np.arange(len(own)))
            root = tied_to
        else:
            tied = np.flatnonzero(root != np.arange(len(own)))
        ids, hashes = table["id"].combine_chunks(), table["hash"].combine_chunks()
        sides = [pa.StructArray.from_arrays([ids.take(pa.array(at)), hashes.take(pa.array(at))], ["id", "hash"]) for at in (tied, root[tied])]
        return pa.table(dict(zip("ab", sides)))

    paired = in_blocks(many, ["choice", "block"], ["node"], 512).select("choice", "block", "low", "high", "own", "node.id", "node.hash", *names)
    ties = paired.groupBy("choice", "block", "low", "high").applyInArrow(tie, f"a {node_kind}, b {node_kind}")
    near = connected_components(written(pairs.union(ties).distinct()))
    told = texts.join(near.select("node.id", "node.hash", "root"), (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash")))
    told = told.dropDuplicates(["id", "hash"]).select(F.struct("id", "hash").alias("node"), "root", "text")
    links = near_links(written(told), width=width, similarity=similarity)
    equal = prints.select(named.alias("a"), "fp").join(fps.select("fp", F.col("node").alias("b")), "fp").where("a <> b").select("a", "b").distinct()
    grouped = connected_components(links.union(equal))
    return grouped.select(F.col("node.id").alias("doc_id"), F.col("node.hash").alias("text_hash"), F.col("root.id").alias("similar_id"), F.col("root.hash").alias("similar_hash"))


def near_links(told: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """Links (``a``, ``b``) that connect all texts of a candidate group whose shingle sets are at ``similarity``, and no others.

    ``told`` has ``node``, the group's ``root`` and ``text``. A group is cut into blocks of ``COMPARED`` texts
    or ``COMPARED_BYTES``. Within a block all pairs are compared, which settles every group of one block and leaves each part of
    a larger one with a representative. Representatives are compared next; in a large group of near copies that
    joins everything, so its texts are moved once and its links are fewer than its texts. Only if parts of a group
    are still apart, their texts are compared across blocks: all but those of one large part with each other.
    """
    node_kind = told.schema["node"].dataType.simpleString()
    size = F.greatest(F.ceil(F.count("*") / F.lit(COMPARED)), F.ceil(F.sum(F.octet_length("text")) / F.lit(COMPARED_BYTES))).cast("int")

    def compared(table: pa.Table, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = [shingle_set(text.as_py(), width) for text in table["text"]]
        common = common_shingles(sets, left, right)
        sizes = np.array(list(map(len, sets)))
        a, b = np.nonzero(common / (sizes[left][:, None] + sizes[right][None, :] - common) >= similarity)
        return left[a], right[b]

    def inside(table: pa.Table) -> pa.Table:
        every = np.arange(table.num_rows)
        first = least_tied(len(every), *compared(table, every, every))
        nodes = table["node"].combine_chunks()
        return pa.table({"root": table["root"], "blocks": table["blocks"], "node": nodes, "first": nodes.take(pa.array(first))})

    held = told.groupBy("root").agg(size.alias("blocks"), F.count("*").alias("held")).where("held > 1").drop("held")
    cut = told.join(held, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    kinds = f"root {node_kind}, blocks int, node {node_kind}, first {node_kind}"
    parts = written(cut.groupBy("root", "own").applyInArrow(inside, kinds))
    links = parts.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    large = parts.where("blocks > 1")

    def across(table: pa.Table) -> pa.Table:
        own, part = table["own"].to_numpy(), table["part"].combine_chunks()
        left, right = (np.flatnonzero(own == table[side][0].as_py()) for side in ("low", "high"))
        a, b = compared(table, left, right)
        _, number = np.unique(np.array([str(p) for p in part.to_pylist()]), return_inverse=True)
        some = np.zeros(number.max() + 1, np.int64)
        some[number] = np.arange(len(number))
        apart = number[a] != number[b]
        least = least_tied(len(some), number[a[apart]], number[b[apart]])
        tied = np.flatnonzero(least != np.arange(len(some)))
        return pa.table({"a": part.take(pa.array(some[tied])), "b": part.take(pa.array(some[least[tied]]))})

    both = f"a {node_kind}, b {node_kind}"
    firsts = large.select("root", F.col("first").alias("node")).distinct().join(told.select("node", "text"), "node")
    firsts = in_blocks(firsts.withColumn("part", F.col("node")), ["root"], ["node"], COMPARED)
    met = written(firsts.groupBy("root", "low", "high").applyInArrow(across, both))
    joined = connected_components(met)
    part = F.coalesce("joined", "first")
    labelled = large.join(joined.select(F.col("node").alias("first"), F.col("root").alias("joined")), "first", "left").select("root", "node", part.alias("part"))
    labelled = written(labelled)
    split = labelled.groupBy("root").agg((F.min("part") < F.max("part")).alias("split")).where("split").select("root")
    open_ = labelled.join(split, "root").join(told.select("node", "text"), "node")
    # Blocks of one large part are not compared with each other; small parts share blocks.
    weight = open_.groupBy("root", "part").agg(size.alias("slices"))
    mixed = open_.join(weight.where("slices = 1"), ["root", "part"]).groupBy("root").agg(size.alias("shared"))
    placed = open_.join(weight, ["root", "part"]).join(mixed, "root", "left")
    alone = F.col("slices") > 1
    own = F.when(alone, F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("slices")))).otherwise(F.pmod(F.xxhash64("node"), F.col("shared")))
    placed = placed.select("root", "node", "part", "text", own.alias("own"), F.when(alone, F.col("part")).alias("only"))
    blocks = placed.select("root", "own", "only").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    unlike = ~F.coalesce(F.col("x.only") == F.col("y.only"), F.lit(False))
    facing = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.own") <= F.col("y.own")) & unlike)
    facing = facing.select("x.root", F.col("x.own").alias("low"), F.col("y.own").alias("high"))
    sides = facing.withColumn("own", F.explode(F.array_distinct(F.array("low", "high"))))
    crossed = sides.join(placed.drop("only"), ["root", "own"]).groupBy("root", "low", "high").applyInArrow(across, both)
    return written(links.union(met).union(crossed).distinct())


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the set of word shingles of the lower-cased text; none for a text without words."""
    rest, seen = [], set()
    for piece in text_pieces((text or b"").lower()):
        found = rest + piece.split()
        shingles = [b" ".join(s) for s in zip(*(found[i:] for i in range(width)))]
        rest = found[len(found) - width + 1 :] if shingles else found
        seen.update(map(xxhash.xxh3_64_intdigest, shingles))
    if not seen and rest:
        seen.add(xxhash.xxh3_64_intdigest(b" ".join(rest)))
    return np.sort(np.fromiter(seen, np.uint64, len(seen)))


def common_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """How many hashes each of the sets ``left`` shares with each of the sets ``right``."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Hashes of one set only are common to no two.
    several = held > 1
    number = several.cumsum() - 1
    some = several[place]
    owner, place = owner[some], number[place[some]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(left), len(right)))
    for start in range(0, int(several.sum()), at_once):
        low, high = np.searchsorted(place, [start, start + at_once])
        has = np.zeros((len(sets), at_once), np.float32)
        has[owner[low:high], place[low:high] - start] = 1
        common += has[left] @ has[right].T
    return common


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """SimHash of ``words`` times 64 bits over the hashes of a set of shingles."""
    ones, n = np.zeros((words, BITS), np.int64), 0
    for start in range(0, len(hashes), 1 << 14):
        some = hashes[start : start + (1 << 14)]
        n += len(some)
        for i in range(words):
            # One hash of the shingle is mixed on to as many as are needed.
            mixed = (some + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))).copy()
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed ^= mixed >> np.uint64(shift)
                mixed *= np.uint64(factor)
            mixed ^= mixed >> np.uint64(31)
            ones[i] += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones.ravel() * 2 > n, bitorder="little").tobytes()


def keep_one(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` left when one document of each group of near copies (``wide_groups``) stays: the smallest doc_id.

    Of rows that repeat doc_id and text, the one with the smallest other columns stays; rows of one doc_id with unlike texts
    all stay. Rows without a doc_id cannot be named by a group and all stay, and so do texts without words.
    """
    grouped = wide_groups(docs, width=width, similarity=similarity)
    gone = grouped.where("doc_id <> similar_id or text_hash <> similar_hash").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text"))
    hashed = docs.where(F.col("doc_id").isNotNull()).withColumn("__hash", F.xxhash64("text"))
    kept = hashed.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__hash") == F.col("__text")), "left_anti")
    others = [c for c in docs.columns if c != "doc_id"]
    kept = kept.groupBy("doc_id", "__hash").agg(F.min(F.struct(*others)).alias("__row"))
    return kept.select(*["doc_id" if c == "doc_id" else F.col("__row").getField(c).alias(c) for c in docs.columns]).union(
        docs.where(F.col("doc_id").isNull())
    )

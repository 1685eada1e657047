"""Ranked lexical search: documents grouped by which of an item's terms they hold, best groups first."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtime.llm.common import text_pieces, written

#: Bytes of item texts that are searched for in one pass over the documents.
ITEM_BYTES = 1 << 20
#: Terms times documents of a block of bitmaps.
BLOCK_BITS = 1 << 24
#: Documents that are scored before the threshold is looked at again.
FIRST_SCORED = 32

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def count_terms(text: bytes, index: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each term of ``index`` occurs, by its number."""
    total, found = 0, Counter()
    for piece in text_pieces(text):
        terms = piece.translate(_FOLD).split()
        total += len(terms)
        found.update(map(index.get, terms))
    found.pop(None, None)
    return total, found


@dataclass
class Item:
    """An item of a pass: its numbered terms and their weights times how often the item holds them."""

    item_id: object
    terms: np.ndarray
    weights: np.ndarray


class Block:
    """Documents of a block by term: a bitmap and the greatest part of a score for each term met."""

    def __init__(self, terms: np.ndarray, parts: np.ndarray, offsets: np.ndarray, vocabulary: int):
        self.terms, self.parts, self.offsets = terms, parts, offsets
        self.size = len(offsets) - 1
        document = np.repeat(np.arange(self.size), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        present, starts = np.unique(terms[order], return_index=True)
        self.row_of = np.full(vocabulary, -1)
        self.row_of[present] = np.arange(len(present))
        self.greatest = np.maximum.reduceat(parts[order], starts)
        held = np.zeros((len(present), self.size), bool)
        held[self.row_of[terms], document] = True
        self.bitmaps = np.packbits(held, axis=1)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks of the terms in ``rows`` as booleans, documents in order of their masks, and where each mask begins."""
        bits = self.bitmaps[rows]
        any_held = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=self.size))
        columns = np.unpackbits(bits, axis=1, count=self.size)[:, any_held]
        packed = np.packbits(columns, axis=0).T
        words = np.zeros((len(any_held), -(-packed.shape[1] // 8) * 8), np.uint8)
        words[:, : packed.shape[1]] = packed
        words = words.view(np.uint64)
        order = np.lexsort(words.T)
        words = words[order]
        new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
        documents = any_held[order]
        return columns.T[order[new]].astype(bool), documents, np.append(new, len(documents))

    def scores(self, documents: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, by their own terms."""
        sizes = self.offsets[documents + 1] - self.offsets[documents]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.offsets[documents] - starts, sizes)
        return np.add.reduceat(weight_of[self.terms[at]] * self.parts[at], starts)


def search_block(block: Block, item: Item, weight_of: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block and their scores, among them all of the ``k`` best that score at least ``least``.

    Distinct masks are taken in the order of the most that any document of theirs can score. It
    is safe to stop where that is below the ``k``-th best score so far, in this block or before it:
    at equality a document may still win by its number.
    """
    rows = block.row_of[item.terms]
    met = rows >= 0
    most = item.weights[met] * block.greatest[rows[met]]
    documents, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if most.sum() < least:
        return documents[0], scores[0]
    masks, by_mask, starts = block.masks(rows[met])
    bounds = masks.astype(np.int64) @ most
    order = np.argsort(-bounds, kind="stable")
    weight_of[item.terms] = item.weights
    first, step = 0, FIRST_SCORED
    while first < len(order) and bounds[order[first]] >= least:
        last, chosen = first, 0
        while last < len(order) and chosen < step and bounds[order[last]] >= least:
            chosen += starts[order[last] + 1] - starts[order[last]]
            last += 1
        taken = np.concatenate([by_mask[starts[m] : starts[m + 1]] for m in order[first:last]])
        documents.append(taken)
        scores.append(block.scores(taken, weight_of))
        so_far = np.concatenate(scores)
        if len(so_far) >= k:
            least = max(least, int(np.partition(so_far, -k)[-k]))
        first, step = last, step * 2
    weight_of[item.terms] = 0
    return np.concatenate(documents), np.concatenate(scores)


def _counted(documents: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` and counts of the terms of ``index`` for every document with a term at all."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            rows, totals, terms, counts, offsets = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                total, found = count_terms(text.as_py() or b"", index)
                if total:
                    rows.append(i)
                    totals.append(total)
                    terms.extend(found.keys())
                    counts.extend(found.values())
                    offsets.append(len(terms))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(totals, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return written(texts.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, counts array<bigint>"))


def _search(counted: DataFrame, items: list[Item], vocabulary: int, documents: int, terms: int, k: int, item_kind: str) -> DataFrame:
    """Each task's ``k`` best documents of every item, from blocks of bitmaps that see the best so far."""
    kind = counted.schema["doc_id"].dataType.simpleString()

    def search(batches):
        best = [[] for _ in items]
        weight_of = np.zeros(vocabulary, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids = batch.column("doc_id")
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            lists = batch.column("terms")
            # A document of n terms has the length part 25 + 75 n N / L, in whole numbers.
            length = 25 + 75 * batch.column("n").to_numpy() * documents // terms
            offsets = lists.offsets.to_numpy().astype(np.int64)
            low = offsets[0]
            numbers, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            offsets = offsets - low
            parts = (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(length, np.diff(offsets)))
            step = max(64, BLOCK_BITS // max(1, min(vocabulary, len(numbers))))
            for start in range(0, len(ids), step):
                stop = min(start + step, len(ids))
                a, b = offsets[start], offsets[stop]
                block = Block(numbers[a:b], parts[a:b], offsets[start : stop + 1] - a, vocabulary)
                for item, held in zip(items, best):
                    least = max(1, held[-1][0]) if len(held) == k else 1
                    found, scores = search_block(block, item, weight_of, k, least)
                    good = scores >= least
                    found, scores = found[good] + start, scores[good]
                    top = np.lexsort((place[found], -scores))[:k]
                    rows = [(int(scores[i]), ids[int(found[i])].as_py()) for i in top]
                    held[:] = sorted(held + rows, key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:k]
        if id_type is not None:
            rows = [(n, *r) for n, held in enumerate(best) for r in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([items[n].item_id for n, _, _ in rows], item_type), pa.array([d for _, _, d in rows], id_type), pa.array([s for _, s, _ in rows], pa.int64())],
                ["item_id", "doc_id", "score"],
            )

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return counted.where(F.size("terms") > 0).mapInArrow(search, f"item_id {item_kind}, doc_id {kind}, score long")


def rank_documents(documents: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best of ``documents`` (``doc_id``, ``text``) for each of ``items`` (``item_id``, ``text``).

    Presence-mask grouping. The documents are read once for the terms of the items; a document
    keeps its length and the counts of those terms. A block of documents has one bitmap per
    term; an item's bitmaps, read across, give every document the mask of the terms it holds.
    Documents of one mask form a group, and groups are scored in the order of the most their mask
    can bring (weights times the greatest part of each term in the block), until no group left
    can reach the ``k``-th best score that the task has found. Tasks give ``k`` rows an item, which one window merges.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), all else is in 64-bit whole numbers. Only scores
    above 0 are given; equal ones rank by doc_id, null last. Items are searched in passes of about
    ``ITEM_BYTES`` of text (a pass reads the documents anew), so only one pass is in memory at a time.
    A null or empty text has no terms: as a document it does not count, as an item it finds
    nothing. Equal items count once; different texts of one item_id are one item with the terms of
    all. Rows that share a doc_id are documents of their own. Other columns are ignored.
    Workers that lack this package need ``common.ship`` first, as the queries call it.
    """
    asked = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    item_kind = items.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    passes = -(-size // ITEM_BYTES)
    found = documents.sparkSession.createDataFrame([], f"item_id {item_kind}, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score long")
    for number in range(passes):
        bags: dict[object, Counter] = defaultdict(Counter)
        chosen = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        for row in chosen.select("item_id", F.col("text").cast("binary").alias("text")).collect():
            bags[row["item_id"]].update(bytes(row["text"]).translate(_FOLD).split())
        index = {term: i for i, term in enumerate(sorted(set().union(*bags.values())))}
        if not index:
            continue
        counted = _counted(documents, index)
        whole = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        holding = np.zeros(len(index))
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[row["term"]] = row["count"]
        weights = np.floor(1000 * np.log((2 * whole["documents"] + 2) / (2 * holding + 1))).astype(np.int64)
        numbered = []
        for item_id, bag in bags.items():
            terms = np.array([index[t] for t in bag], np.int64)
            numbered.append(Item(item_id, terms, weights[terms] * np.array(list(bag.values()), np.int64)))
        found = found.union(_search(counted, numbered, len(index), whole["documents"], whole["terms"] or 1, k, item_kind))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same rank in SQL over ``documents`` and ``benchmark``.
SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
sizes AS (SELECT count(*)::BIGINT AS N_docs, sum(n)::BIGINT AS L FROM docs),
tf AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(N_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term),
items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
  GROUP BY ALL),
length AS (SELECT row_id, doc_id, 100 - 75 + ((75 * n * N_docs) // L) AS m FROM docs, sizes),
scored AS (
  SELECT item_id, doc_id, row_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN length USING (row_id)
  GROUP BY item_id, doc_id, row_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

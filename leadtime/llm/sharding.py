"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import number_rows, stepped


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, where it hangs, and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(n: int, *, built: int | None = None, racks: int = 4, per_rack: int = 4) -> list[Shard]:
    """``n`` shards of equal weight, ``per_rack`` in a rack and ``racks`` racks in a region.

    Shards from ``built`` on were added later. Each hangs in a region of its own, so that what it
    takes comes from the others and goes to nobody else.
    """
    built = n if built is None else built
    tree = [Shard(i, f"region{i // (racks * per_rack)}", f"rack{i // per_rack % racks}") for i in range(built)]
    return tree + [Shard(i, f"added{i}", "rack0") for i in range(built, n)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """Weighted hash draw of a child: an exponential variable at the rate of its weight; the least wins.

    It depends on the key, the child's name and its weight only, so a change of weight moves keys
    to or from that child alone.
    """
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


def _descend(key: Column, shards: Sequence[Shard], level: int, path: str) -> Column:
    """The shard that ``key`` reaches below ``path``: one draw among the children of each level."""
    if level == 3:
        return F.lit(shards[0].shard)
    children: dict[str, list[Shard]] = {}
    for s in shards:
        children.setdefault((s.region, s.rack, f"shard{s.shard}")[level], []).append(s)
    below = [_descend(key, own, level + 1, f"{path}/{name}") for name, own in children.items()]
    if len(children) == 1:
        return below[0]
    draws = [
        _draw(key, f"{path}/{name}", sum(s.weight for s in own)) for name, own in children.items()
    ]
    first = F.least(*draws)
    chosen = below[-1]
    for draw, child in list(zip(draws, below))[-2::-1]:
        chosen = F.when(draw == first, child).otherwise(chosen)
    return chosen


def tree_shard(key: Column, tree: Sequence[Shard]) -> Column:
    """Number of the shard of ``key`` in the tree, by weighted hash draws at region, rack and shard level.

    A changed weight moves keys only between the changed subtree and its siblings; subtrees whose
    weights stay keep their inner placement. Shards of weight 0 must be left out of the tree.
    """
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("a tree needs shards, each of a weight above 0")
    if len({s.shard for s in tree}) < len(tree):
        raise ValueError("shard numbers must differ")
    return _descend(key, list(tree), 0, "").cast("int")


def shard_documents(docs: DataFrame, tree: Sequence[Shard], *, grown: Sequence[Shard] | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard and a gapless place in it.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text, none for null, plus 1), ``text_crc32``,
    ``shard``, ``slot`` (from 0 in each shard) and ``grown_shard`` (the shard in ``grown``, null
    without it). The place depends on doc_id alone; rows without one are drawn by their null.
    Repeated rows get a slot each: equal ones are folded into a count, numbered in steps and
    unfolded, so that a third of all rows may be equal. Other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    folded = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = folded.withColumn("shard", tree_shard(F.col("doc_id"), tree)).withColumn(
        "grown_shard", tree_shard(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    )
    numbered = number_rows(stepped(placed), ["shard"], ["doc_id", "size", "text_crc32", "from"], copies="n")
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"),
    )

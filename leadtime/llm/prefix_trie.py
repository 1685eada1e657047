"""Trie of conversation prefixes by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import written

#: Bytes of a turn's code in a path.
CODE = 16
#: Forests of neighbouring partitions that one task merges.
FAN = 64
#: Width of the range of conv_ids whose decimals are joined in one row.
ID_RANGE = 4096

EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_FIELDS = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, own_key binary, parent_key binary, "
    "part int, place int, edge long, path binary, lengths array<int>"
)
_NODE, _ITEM = 0, 1


@dataclass
class Item:
    """Neighbouring sequences that are one at depth ``top``: a node there that is not closed yet.

    ``leaves`` and ``saved`` are sums over what hangs below the node; ``waiting`` names closed chains whose
    parent is the node. ``path`` and ``lengths`` reach to ``top`` at least.
    """

    top: int
    n: int
    conv: int
    path: bytes
    lengths: list[int]
    ends: str | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    waiting: list["Chain"] = field(default_factory=list)


@dataclass
class Chain:
    """Nodes of one line, from below depth ``above`` down to ``item.top``, all with the same members."""

    item: Item
    above: int
    parent: int | None = None
    own_key: bytes | None = None
    parent_key: bytes | None = None


def key_at(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * CODE]).digest()


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning, found by halving."""
    low, high = 0, min(len(a), len(b)) // CODE
    if a[: high * CODE] == b[: high * CODE]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low * CODE : middle * CODE] == b[low * CODE : middle * CODE]:
            low = middle
        else:
            high = middle
    return low


def border_edges(edges: list[int]) -> set[int]:
    """Edges less than all before them, and those less than all after: only they may join components that reach an end."""
    border = set()
    for order in (range(len(edges)), range(len(edges) - 1, -1, -1)):
        least = None
        for i in order:
            if least is None or edges[i] < least:
                least = edges[i]
                border.add(i)
    return border


def contract(items: list[Item], edges: list[int], closed: list[Chain], *, sealed: bool = False, keyed: bool = False) -> tuple[list[Item], list[int]]:
    """Join sorted neighbours by union-find in descending order of their common depth.

    ``edges[i]`` is the depth at which items ``i`` and ``i + 1`` become one. Each joining makes, or widens, a branching
    node at that depth; what hung deeper is closed and its chain of nodes appended to ``closed``.
    Components that reach the first or the last item may go on beyond them; they stay open, as a
    short list of items and edges that stands for the whole part: depths fall towards the least
    edge and rise again after it. With ``sealed`` nothing lies beyond, and all is closed up to
    the root. ``keyed`` gives closed chains a key by which children closed earlier find them.
    """

    def down(item: Item, depth: int) -> Item:
        if item.top <= depth:
            return item
        chain = Chain(item, depth)
        closed.append(chain)
        if keyed:
            chain.own_key = key_at(item.path, item.top)
        for child in item.waiting:
            child.parent = item.conv
        item.waiting = []
        spared = (item.n - 1) * sum(item.lengths[max(depth, 0) : item.top])
        leaves = item.leaves + (item.kids == 0)
        return Item(depth, item.n, item.conv, item.path, item.lengths, None, 1, leaves, item.saved + spared, [chain])

    def joined(a: Item, b: Item) -> Item:
        more, less = (a.waiting, b.waiting) if len(a.waiting) >= len(b.waiting) else (b.waiting, a.waiting)
        more.extend(less)
        return Item(a.top, a.n + b.n, min(a.conv, b.conv), a.path, a.lengths, a.ends or b.ends, a.kids + b.kids, a.leaves + b.leaves, a.saved + b.saved, more)

    border = set() if sealed else border_edges(edges)
    root, held = list(range(len(items))), list(items)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for edge in sorted((i for i in range(len(edges)) if i not in border), key=lambda i: -edges[i]):
        a, b = find(edge), find(edge + 1)
        root[b] = a
        held[a] = joined(down(held[a], edges[edge]), down(held[b], edges[edge]))
    if sealed:
        top = down(held[find(0)], 0) if items else None
        if top is not None:
            down(top, -1)
        return [], []
    kept, spine = [], sorted(border)
    for number, start in enumerate([0, *(i + 1 for i in spine)] if items else []):
        item = held[find(start)]
        if 0 < number < len(spine):
            item = down(item, max(edges[spine[number - 1]], edges[spine[number]]))
        kept.append(item)
    for item in kept:
        if item.waiting:
            key = key_at(item.path, item.top)
            for child in item.waiting:
                child.parent_key = key
            item.waiting = []
    return kept, [edges[i] for i in spine]


def _batch(columns: dict[str, list], kind: int) -> pa.RecordBatch:
    types = {
        "kind": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
        "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
        "own_key": pa.binary(), "parent_key": pa.binary(), "part": pa.int32(), "place": pa.int32(), "edge": pa.int64(),
        "path": pa.binary(), "lengths": pa.list_(pa.int32()),
    }
    size = len(columns["conv_id"])
    arrays = []
    for name, type_ in types.items():
        if name == "kind":
            arrays.append(pa.array(np.full(size, kind, np.int32)))
        else:
            arrays.append(pa.array(columns[name], type_) if name in columns else pa.nulls(size, type_))
    return pa.RecordBatch.from_arrays(arrays, list(types))


def node_rows(chains: list[Chain], size: int = 20_000):
    """The nodes of closed chains, one row a depth, in batches."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "own_key", "parent_key"]
    columns: dict[str, list] = {n: [] for n in names}
    for chain in chains:
        item = chain.item
        saved, leaves = item.saved, item.leaves + (item.kids == 0)
        for depth in range(item.top, chain.above, -1):
            bottom, first = depth == item.top, depth == chain.above + 1
            if depth:
                saved += (item.n - 1) * item.lengths[depth - 1]
            row = (
                item.conv,
                depth,
                None if depth == 0 else chain.parent if first else item.conv,
                item.n,
                item.kids if bottom else 1,
                leaves,
                saved,
                (item.ends or EMPTY_SHA) if bottom else EMPTY_SHA,
                chain.own_key if bottom else None,
                chain.parent_key if first and depth else None,
            )
            for name, value in zip(names, row):
                columns[name].append(value)
            if len(columns["depth"]) >= size:
                yield _batch(columns, _NODE)
                columns = {n: [] for n in names}
    if columns["depth"]:
        yield _batch(columns, _NODE)


def forest_rows(part: int, items: list[Item], edges: list[int]) -> pa.RecordBatch:
    """An open forest: only its first and last item carry their paths, of which all others are beginnings."""
    last = len(items) - 1
    ends = [i in (0, last) for i in range(len(items))]
    return _batch(
        {
            "conv_id": [i.conv for i in items],
            "depth": [i.top for i in items],
            "n_convs": [i.n for i in items],
            "n_children": [i.kids for i in items],
            "n_leaves": [i.leaves for i in items],
            "saved_tokens": [i.saved for i in items],
            "ends_sha256": [i.ends for i in items],
            "part": [part] * len(items),
            "place": list(range(len(items))),
            "edge": [*edges, None],
            "path": [i.path if e else None for i, e in zip(items, ends)],
            "lengths": [i.lengths if e else None for i, e in zip(items, ends)],
        },
        _ITEM,
    )


def read_forest(rows: list[dict]) -> tuple[list[Item], list[int]]:
    """Items and edges back from the rows of one part, in order."""
    edges = [r["edge"] for r in rows[:-1]]
    items = []
    for i, r in enumerate(rows):
        left = i == 0 or (i < len(rows) - 1 and r["depth"] == edges[i - 1])
        end = rows[0] if left else rows[-1]
        items.append(Item(r["depth"], r["n_convs"], r["conv_id"], end["path"], end["lengths"], r["ends_sha256"], r["n_children"], r["n_leaves"], r["saved_tokens"]))
    return items, edges


def appended(forest: tuple[list[Item], list[int]], more: tuple[list[Item], list[int]]) -> tuple[list[Item], list[int]]:
    """Two neighbouring forests side by side, tied where the last path of one meets the first of the other."""
    if not forest[0] or not more[0]:
        return forest if forest[0] else more
    border = common_turns(forest[0][-1].path, more[0][0].path)
    return forest[0] + more[0], forest[1] + [border] + more[1]


def _plant(batches):
    """Nodes and the open forest of one partition of sorted distinct sequences, batch by batch."""
    forest: tuple[list[Item], list[int]] = ([], [])
    for batch in batches:
        rows = batch.to_pylist()
        items = [Item(len(r["path"]) // CODE, r["n"], r["conv"], r["path"], r["lengths"], r["ends"]) for r in rows]
        closed: list[Chain] = []
        edges = [common_turns(a.path, b.path) for a, b in zip(items, items[1:])]
        more = contract(items, edges, closed)
        yield from node_rows(closed)
        closed = []
        forest = contract(*appended(forest, more), closed, keyed=True)
        yield from node_rows(closed)
    if forest[0]:
        yield forest_rows(TaskContext.get().partitionId(), *forest)


def _graft(sealed: bool, fan: int):
    """A function that merges the forests of up to ``fan`` neighbouring parts; ``sealed`` if there are no others."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["place"]))
        forest: tuple[list[Item], list[int]] = ([], [])
        start, unit = 0, rows[0]["part"] // fan
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i]["part"] != rows[start]["part"]:
                forest = appended(forest, read_forest(rows[start:i]))
                start = i
        closed: list[Chain] = []
        forest = contract(*forest, closed, sealed=sealed, keyed=True)
        batches = list(node_rows(closed))
        if forest[0]:
            batches.append(forest_rows(unit, *forest))
        return pa.Table.from_batches(batches or [_batch({"conv_id": []}, _NODE)])

    return merge


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of a code and a length in code points per turn, in order of ``turn``, null first.

    Turns at one place are ordered by their codes. A code is 128 bits over role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(
        F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn"), code.alias("code"), F.char_length(text).alias("chars")
    )
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["code"].alias("code"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(seqs: DataFrame, *, every: int = 100, limit: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the conversation at the last multiple of ``every``.

    h is the CRC-32 of the decimal conv_id modulo ``limit``. If there is no such conversation, its part is empty.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, limit - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % limit).cast("int")
    own = seqs.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return own.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _ends(parts: DataFrame) -> DataFrame:
    """``path`` and ``ends`` of sequences with many members: their decimals, range by range, through one running hash.

    A hash over one list is computed in turn by its nature; only joined decimals of whole ranges reach it, and
    a task keeps no more than the one it reads.
    """

    def run(batches):
        path, state = None, None
        for batch in batches:
            done: dict[str, list] = {"path": [], "ends": []}
            for p, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
                if p != path:
                    if state is not None:
                        done["path"].append(path)
                        done["ends"].append(state.hexdigest())
                    path, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict(done, pa.schema([("path", pa.binary()), ("ends", pa.string())]))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"path": [path], "ends": [state.hexdigest()]}, pa.schema([("path", pa.binary()), ("ends", pa.string())]))

    ordered = parts.repartition("path").sortWithinPartitions("path", "range")
    return ordered.select("path", "ids").mapInArrow(run, "path binary, ends string")


def _distinct(seqs: DataFrame) -> DataFrame:
    """Distinct sequences: ``path``, ``lengths``, members ``n``, least member ``conv``, and the hash of all members."""
    hexes = F.array_join(F.transform("turns", lambda t: t["code"]), "")
    coded = seqs.select("conv_id", F.unhex(hexes).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("lengths"))
    decimals = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = written(
        coded.groupBy("path", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(
            F.first("lengths").alias("lengths"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), decimals.alias("ids")
        )
    )
    folded = parts.groupBy("path").agg(
        F.first("lengths").alias("lengths"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.count("*").alias("ranges"), F.min("ids").alias("ids")
    )
    single = folded.where("ranges = 1").select("path", "lengths", "n", "conv", F.sha2(F.col("ids"), 256).alias("ends"))
    many = folded.where("ranges > 1").select("path", "lengths", "n", "conv")
    hashed = _ends(parts.join(many.select("path"), "path", "left_semi"))
    return written(single.union(many.join(hashed, "path").select("path", "lengths", "n", "conv", "ends")))


def prefix_trie(seqs: DataFrame, *, fan: int = FAN) -> DataFrame:
    """One row per distinct beginning of the sequences (``conv_id``, ``turns`` as of ``sequences``), the empty one included.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the parent's
    conv_id (null at the root), ``n_convs`` members, ``n_children`` children, ``n_leaves`` childless nodes of the subtree, ``saved_tokens``
    over the subtree (members less one, times code points of the last turn), ``ends_sha256`` the
    hash of the members that end at the node.

    Equal sequences are folded first. The distinct ones are sorted by ranges; within a batch union-find over
    the edges between sorted neighbours, in descending order of the depth they share, makes a branching node of
    every merge. What cannot reach beyond a batch or a partition is final and written; the rest is contracted to
    two short spines of at most as many items as there are turns, and the forests of neighbouring partitions are
    merged, ``fan`` at a time, until one is left. Children closed before their parent find it by a key.

    A conversation is one row of 36 bytes a turn, so its texts may be of any length, and one of a
    million turns takes some 36 MB; no other group is held whole, whatever its share of the rows. Rows without
    a conv_id are left out, null roles and texts are empty ones; a conversation without turns ends at the root.
    No rows give no nodes. Equal rows are turns of their own. Other columns are ignored.
    Workers that lack this package need ``common.ship`` first, as the queries call it.
    """
    paths = _distinct(seqs).select("path", "lengths", "n", "conv", "ends")
    ordered = paths.repartitionByRange("path").sortWithinPartitions("path")
    level = written(ordered.mapInArrow(_plant, _FIELDS))
    nodes, forests = [level.where(F.col("kind") == _NODE)], level.where(F.col("kind") == _ITEM)
    last = forests.agg(F.max("part").alias("part")).first()["part"]
    while last is not None:
        sealed = last < fan
        merged = written(forests.groupBy(F.expr(f"part div {fan}")).applyInArrow(_graft(sealed, fan), _FIELDS))
        nodes.append(merged.where(F.col("kind") == _NODE))
        forests, last = merged.where(F.col("kind") == _ITEM), None if sealed else last // fan
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.union(more)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = whole.where("own_key is not null").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    found = whole.where("parent_key is not null").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("__parent"))
    return whole.where("parent_key is null").select(*names).union(found.select(*names))


def conversation_nodes(turns: DataFrame, *, every: int = 100, limit: int = 6) -> DataFrame:
    """The prefix trie of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``) after ``with_shared_heads``."""
    return prefix_trie(with_shared_heads(sequences(turns), every=every, limit=limit))


#: The same nodes in SQL over ``conversations``, by listing every beginning of every conversation.
SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table),
rebuilt AS (
  SELECT c.conv_id, o.p, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.p <= c.h
  UNION ALL
  SELECT c.conv_id, o.p, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.p > c.h),
placed AS (
  SELECT conv_id, length(text) AS chars, row_number() OVER w AS d,
         string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
prefixes AS (
  SELECT conv_id, d, md5(path) AS key, chars FROM placed
  UNION ALL SELECT conv_id, 0, md5(''), 0 FROM convs),
members AS (SELECT *, lag(key) OVER w AS parent, lead(d) OVER w IS NULL AS ended FROM prefixes WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM members GROUP BY key, d),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (key)),
below AS (SELECT DISTINCT a.key AS top, b.key AS key FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM below JOIN full_nodes USING (key) GROUP BY top)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (key) LEFT JOIN full_nodes p ON p.key = n.parent
"""

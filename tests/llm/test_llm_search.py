"""Search and trie operators against brute force, on odd rows and with small blocks, shards and forests."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtime.llm import catalogue, lexical, maxscore, prefix_trie
from oracle import compare, database

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_prefix_trie", "op13_exact_topk"])
def test_same_rows_as_sql(spark, name):
    assert compare(catalogue.QUERIES[name](spark, SF), database(SF), catalogue.ORACLE[name]) == []


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(list)
    for item, text in set(items):
        if text is not None:
            asked[item] += terms(text)
    rows = []
    for item, words in asked.items():
        scores = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        rows += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(rows, key=str)


ODD_DOCS = [
    (1, "Alpha beta, gamma-delta ALPHA"), (2, None), (3, ""), (4, "... !!"), (5, "beta beta Beta bÉta"), (None, "gamma omega"),
    (6, "beta beta Beta bÉta"), (6, "beta beta Beta bÉta"), (7, "x" * 3000 + " omega"), (8, "ünï alpha1 alpha"), (0, "alpha\u0085beta"),
]
ODD_ITEMS = [(1, "alpha alpha beta"), (2, None), (3, ""), (4, "nowhere"), (5, "gamma omega"), (5, "gamma omega"), (5, "beta"), (None, "bÉta")]


@pytest.mark.parametrize("item_bytes", [1 << 20, 8])
def test_ranks_of_odd_documents(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ODD_DOCS], "doc_id long, text string, score int, rank string").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in ODD_ITEMS], "item_id long, text string, doc_id int")
    found = lexical.rank_documents(docs, items, k=3)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == ranked(ODD_DOCS, ODD_ITEMS, 3)


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs.where("doc_id in (2, 3, 4)"), items).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_groups_by_mask_hold_the_best(seed):
    """No document of the best is lost by stopping early, whatever the threshold; few are scored where it is high."""
    rng = np.random.default_rng(seed)
    vocabulary, documents = 150, 700
    held = [np.sort(rng.choice(vocabulary, rng.integers(1, 30), replace=False)) for _ in range(documents)]
    offsets = np.cumsum([0, *map(len, held)])
    numbers = np.concatenate(held)
    parts = rng.integers(1, 1_000_000, len(numbers))
    block = lexical.Block(numbers, parts, offsets, vocabulary)
    weight_of = np.zeros(vocabulary, np.int64)
    for size in (1, 5, 100):
        asked = rng.choice(vocabulary, size, replace=False)
        item = lexical.Item(0, asked, rng.integers(1, 5000, size))
        weight = np.zeros(vocabulary, np.int64)
        weight[asked] = item.weights
        every = np.add.reduceat(weight[numbers] * parts, offsets[:-1])
        masks, by_mask, starts = block.masks(block.row_of[asked])
        assert len(by_mask) == (every > 0).sum() and len({m.tobytes() for m in masks}) == len(masks)
        for m, first, last in zip(masks, starts, starts[1:]):
            for d in by_mask[first:last]:
                assert set(asked[m]) == set(asked) & set(held[d])
        for least in (1, int(np.sort(every)[-3]), int(every.max()) + 1):
            found, scores = lexical.search_block(block, item, weight_of, 10, least)
            assert (scores == every[found]).all() and len(set(found)) == len(found)
            tenth = max(least, np.sort(every)[-10])
            assert {d for d, s in zip(found, scores) if s >= tenth} == set(np.flatnonzero(every >= tenth))
            assert not weight_of.any()


def trie(rebuilt):
    """Nodes of conversations (id → list of (role, text)) by listing every beginning."""
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    rows = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(who), len(path), parent, len(who), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def random_conversations(rng, n, letters="ab", longest=9):
    return {rng.randrange(10**6) * 7 + i: [("user", rng.choice(letters) * rng.randint(1, 2)) for _ in range(rng.randint(0, longest))] for i in range(n)}


@pytest.mark.parametrize("seed", range(30))
def test_forests_cut_anywhere_merge_to_the_trie(seed):
    rng = random.Random(seed)
    convs = random_conversations(rng, rng.choice([1, 2, 40, 120]), rng.choice(["a", "ab", "abc"]))
    by_path = defaultdict(list)
    for c, turns in convs.items():
        by_path[tuple(turns)].append(c)
    items = []
    for turns, who in by_path.items():
        path = b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns)
        ends = hashlib.sha256(",".join(map(str, sorted(who))).encode()).hexdigest()
        items.append(prefix_trie.Item(len(turns), len(who), min(who), path, [len(t[1]) for t in turns], ends))
    items.sort(key=lambda i: i.path)
    cuts = [0, *sorted(rng.sample(range(1, len(items)), min(len(items) - 1, rng.randint(0, 12)))), len(items)]
    batches, level = [], []
    for a, b in zip(cuts, cuts[1:]):
        closed, part = [], items[a:b]
        forest = prefix_trie.contract(part, [prefix_trie.common_turns(x.path, y.path) for x, y in zip(part, part[1:])], closed)
        batches += prefix_trie.node_rows(closed, 7)
        level.append(prefix_trie.forest_rows(0, *forest).to_pylist())
    fan = rng.choice([2, 3])
    while level:
        sealed, merged = len(level) <= fan, []
        for start in range(0, len(level), fan):
            forest, closed = ([], []), []
            for rows in level[start : start + fan]:
                forest = prefix_trie.appended(forest, prefix_trie.read_forest(rows))
            forest = prefix_trie.contract(*forest, closed, sealed=sealed, keyed=True)
            batches += prefix_trie.node_rows(closed)
            if not sealed:
                merged.append(prefix_trie.forest_rows(0, *forest).to_pylist())
        level = merged
    rows = [r for b in batches for r in b.to_pylist()]
    parents = {r["own_key"]: r["conv_id"] for r in rows if r["own_key"]}
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for r in rows:
        if r["parent_key"]:
            r["parent_conv_id"] = parents[r["parent_key"]]
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == trie(convs)


def test_spines_stay_short():
    """An open forest has no more items than twice the turns of its first and last sequences."""
    rng = random.Random(3)
    paths = sorted({b"".join(bytes([rng.randint(0, 3)]) * 16 for _ in range(rng.randint(1, 8))) for _ in range(3000)})
    items = [prefix_trie.Item(len(p) // 16, 1, i, p, [1] * (len(p) // 16), "x") for i, p in enumerate(paths)]
    kept, _ = prefix_trie.contract(items, [prefix_trie.common_turns(a.path, b.path) for a, b in zip(items, items[1:])], [])
    assert len(kept) <= (len(paths[0]) + len(paths[-1])) // 16 + 2


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("fan", [2, 64])
def test_trie_of_odd_conversations(spark, fan):
    rng, rows = random.Random(9), []
    for c in [*range(0, 260), *range(10_000, 10_040), 5_000_000_007]:
        if c in (100,):
            continue
        start = rng.randrange(3)
        rows += [(c, i if i or start else None, rng.choice(["user", None, ""]), rng.choice([None, "", "hé", "a" * 50])) for i in range(start, rng.randint(1, 9))] or [(c, 0, "", "only")]
    rows += [(3_000 + 5_000 * i, 1, "user", "same") for i in range(40)] + [(None, 0, "user", "nobody")] + [(777, i, "user", str(i)) for i in range(300)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, path int").repartition(5)
    seqs = prefix_trie.with_shared_heads(prefix_trie.sequences(table))
    found = prefix_trie.prefix_trie(seqs, fan=fan)
    assert sorted(map(tuple, found.collect()), key=str) == trie(rebuilt(rows))


def test_trie_of_nothing_and_of_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_nodes(empty).count() == 0
    # Its one turn goes, and there is no conversation 100.
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    one = spark.createDataFrame([(c, 0, "user", "gone")], empty.schema)
    assert [tuple(r) for r in prefix_trie.conversation_nodes(one).collect()] == trie({c: []})


def test_common_turns():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 9))) for _ in range(2))
        same = next((i for i in range(min(len(a), len(b)) // 16) if a[16 * i : 16 * i + 16] != b[16 * i : 16 * i + 16]), min(len(a), len(b)) // 16)
        assert prefix_trie.common_turns(a, b) == same


def nearest(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[(i, tuple(min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in v))] = None
    found = []
    by_query = defaultdict(list)
    for q, a in whole:
        if q % every == 0:
            by_query[q] += [(-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), c) for c, b in whole if c != q and len(a) == len(b)]
    for q, scores in by_query.items():
        found += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int").repartition(4)


@pytest.mark.parametrize("sizes", [(2048, 4, 1024), (16, 2, 3)])
def test_exact_top_of_odd_vectors(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD_ROWS", "SLAB_SHARDS", "BLOCK_ROWS"), sizes):
        monkeypatch.setattr(maxscore, name, size)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 0.3)]) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[i % 3][1]) for i in range(150, 220)] + [(i, [-0.5] * 6) for i in range(-30, 0)] + rows[:2]
    rows += [(300, None), (301, [None, 1.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (None, [0.1] * 6), (350, [0.0] * 6), (400, []), (401, []), (402, [1.0])]
    found = maxscore.top_inner_products(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == nearest(rows, 5, 10)


def test_exact_top_beyond_64_bits_and_of_nothing(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 17) for _ in range(4)]) for i in range(40)]
    found = maxscore.top_inner_products(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=3)
    assert sorted(map(tuple, found.collect())) == nearest(rows, 3, 5)
    assert maxscore.top_inner_products(vectors(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_shards_give_all_that_reach_the_threshold(seed):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(-40, 40, (500, 12)) * (rng.random((500, 12)) < 0.5)
    shard = maxscore.Shard(np.arange(500), matrix)
    for query in (rng.integers(-40, 40, 12), np.zeros(12, np.int64), -np.abs(matrix[0])):
        every = matrix @ query
        for least in (None, -5, 0, int(np.sort(every)[-5]), int(every.max()) + 1):
            met, scores = shard.search(query, least)
            assert (scores == every[met]).all()
            assert set(np.flatnonzero(every >= (every.min() if least is None else least))) <= set(met)

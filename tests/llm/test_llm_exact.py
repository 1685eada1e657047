"""Operators against brute force, round trips, held-out accuracy and numeric gradients, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from leadtime.llm import catalogue, packing, scoring, simhash, substrings
from leadtime.llm.catalogue import tokenizer_path
from leadtime.llm.components import connected_components
from leadtime.llm.gru import GruModel, Trainer, score_texts, windows
from leadtime.llm.language import viterbi
from leadtime.llm.mixing import mix, mixed_documents, permuted
from leadtime.llm.resampling import kth_largest
from leadtime.llm.sharding import Shard, even_tree, tree_shard
from leadtime.llm.suffixes import suffix_array
from leadtime.llm.common import text_pieces

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def result(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def roots(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    return root


def test_pieces_of_a_text_keep_its_words():
    text = b"one  two\tthree\n" * 50 + b"x" * 100
    assert sum((p.split() for p in text_pieces(text, 16)), []) == text.split()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, i) for i in range(600, 700)]
    expected = roots(800, links)
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: expected[n] for n in {x for a, b in links if a != b for x in (a, b)}}


def test_simhash_prints_and_groups(spark, docs):
    prints = {}
    for d in docs:
        words = BLANK.findall(lower(d.text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        votes = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                votes[b] += h >> b & 1
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))
    ids = sorted(prints)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 2]
    root = roots(len(ids), links)
    rows = result(spark, "op1_simhash")
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == ids[root[ids.index(r.doc_id)]]


@pytest.mark.parametrize("crowd", [1, 24])
def test_simhash_links_reach_every_close_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(5):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4)))) for _ in range(80)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 2]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    assert roots(len(signed), [(place[a], place[b]) for a, b in links]) == roots(len(signed), near)


def test_similar_shingles_are_grouped_and_others_left(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(300)]
        near = list(words)
        for at in rng.sample(range(300), 3):
            near[at] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    found = {r.doc_id: r.similar_id for r in simhash.wide_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found.get(2 * i + 1) == 2 * i for i in range(60)) >= 57
    assert all(a // 2 == b // 2 for a, b in found.items())


def water_fill(sizes, weights, cap):
    target, free = {}, dict(weights)
    total = sum(sizes.values())
    while True:
        share = (total - sum(target.values())) / sum(free.values())
        over = [s for s in free if free[s] * share > cap * sizes[s]]
        if not over:
            return target | {s: w * share for s, w in free.items()}
        for s in over:
            target[s] = cap * sizes[s]
            del free[s]


def test_mixing_targets_and_words(spark, docs):
    rows = result(spark, "op2_mixing")
    size = {d.doc_id: len(BLANK.findall(d.text)) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += size[d.doc_id]
    targets = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, 3)
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source])
        taken[r.source] += r.taken
        assert sum(s.words for s in r.shards) == r.taken and [s.shard for s in r.shards] == sorted({s.shard for s in r.shards})
    in_shard = Counter()
    for r in rows:
        in_shard.update({s.shard: s.words for s in r.shards})
    assert set(in_shard) == set(range(64)) and max(in_shard.values()) <= 2 * sum(in_shard.values()) / 64
    assert len(rows) == len(docs) and all(abs(taken[s] - targets[s]) <= 100 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, result(spark, "op2_mixing")))


def test_capped_sources_are_taken_whole(spark):
    rows = [(i, "w " * 50, "a") for i in range(2)] + [(9, "w " * 2000, "b")]
    mixed = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8)
    plan = mixed.plan.groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in plan}[1] == 3 * 13
    texts = mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8).collect()
    assert sorted(r.doc_id for r in texts if r.doc_id < 9) == [0, 0, 0, 1, 1, 1]
    assert all(r.text == "w " * 50 for r in texts if r.doc_id < 9)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_packing_round_trip_and_bound(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = result(spark, "op3_packing")
    expected = set()
    for d in docs:
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.add((d.doc_id, n, at, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_words_to_ids_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    words = "Hello, WORLD's don't ### naïve Über-straße x<|endoftext|>y 12ab é ΣΑΣ İstanbul 東京  z ½ ﬁ á ---' <| |> ª".split(" ")
    ids = packing.WordIds(tokenizer_path())
    for w in words:
        assert np.frombuffer(ids.of([w.encode()])[0], "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w
    assert np.frombuffer(ids.of([" ".join(words).encode()])[0], "<u4").tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids


def test_packing_plan_close_to_the_least():
    rng = np.random.default_rng(4)
    lengths = np.concatenate([np.minimum(4096, np.exp(rng.normal(6.6, 1, 20_000)).astype(int) + 2), rng.integers(1, 4097, 6_000)])
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    groups = packing.linear_groups({n: c for n, c in counts.items() if n > 128}, 1024)
    large = packing.plan_large(groups, 4096)
    room = np.full(large.targets, 4096)
    for g, (longest, shortest, n) in enumerate(groups):
        own = np.concatenate([np.full(counts[k], k) for k in counts if shortest <= k <= longest])
        np.subtract.at(room, large.look_up(np.full(n, g), np.arange(n))[0], rng.permutation(own))
    assert room.min() >= 0
    rooms = {int(k): int(v) for k, v in zip(*np.unique(room, return_counts=True))}
    small = packing.plan_small({n: c for n, c in counts.items() if n <= 128}, rooms, 4096)
    assert large.targets + small.targets <= 1.005 * lengths.sum() / 4096 + 1


def test_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    rng = np.random.default_rng(5)
    copies = x[:60] + rng.normal(size=(60, x.shape[1])) * 0.05 * np.linalg.norm(x[:60], axis=1, keepdims=True)
    all_x = np.float32(np.concatenate([x, copies, copies[:5]]))
    from leadtime.llm.embeddings import near_vectors

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_x)], "vec_id long, embedding array<float>")
    unit = all_x.astype(float) / np.linalg.norm(all_x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(unit), np.argwhere(near))
    found = near_vectors(df).collect()
    assert sum(r.n_links for r in found) >= 0.97 * near.sum()
    assert all(r.n_links <= near[r.vec_id].sum() and r.kept == (r.component_id == r.vec_id) for r in found)
    assert sum(r.component_id == root[r.vec_id] for r in found) >= 0.97 * len(found)


def test_resampling_tells_good_from_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = result(spark, "op5_importance")
    kept = {q: [r.selected for r in rows if labels.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(kept[1]) >= 0.97 and np.mean(kept[0]) <= 0.3
    assert all(math.isfinite(r.gumbel_key) for r in rows)


@pytest.mark.parametrize("k", [1, 3, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(6)
    values = [rng.choice([rng.gauss(0, 1), 0.25, -1e9, 1e12]) for _ in range(1000)]
    assert kth_largest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k) == sorted(values, reverse=True)[k - 1]


def test_sharding(spark, docs):
    rows = result(spark, "op6_sharding")
    text = {d.doc_id: d.text for d in docs}
    assert len(rows) == len(docs) and all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for shard in range(16):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_weights_move_only_what_they_must(spark):
    tree = even_tree(8, racks=2, per_rack=2)
    heavier = [Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else 1.0) for s in tree]
    rows = spark.range(20_000).select(tree_shard(F.col("id"), tree).alias("a"), tree_shard(F.col("id"), heavier).alias("b")).collect()
    counts = Counter(r.b for r in rows)
    assert abs(counts[5] / 20_000 - 0.3) < 0.02 and max(Counter(r.a for r in rows).values()) < 1.1 * 20_000 / 8
    # Region 0 loses to region 1, and keeps its inner placement.
    assert all(r.a == r.b for r in rows if r.b < 4) and all(r.b >= 4 for r in rows if r.a != r.b)


def test_language_accuracy_on_held_out_texts(spark, docs):
    lang = {d.doc_id: d.lang for d in docs}
    rows = result(spark, "op7_language")
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(docs) and np.mean(own) >= 0.95


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(7)
    for _ in range(200):
        scores = -rng.exponential(2, size=(rng.integers(1, 7), 3))
        from itertools import product

        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert math.isclose(value(viterbi(scores, 2.5)), max(map(value, product(range(3), repeat=len(scores)))), rel_tol=1e-9)


def test_suffix_array():
    rng = np.random.default_rng(8)
    for alphabet in (1, 2, 4, 256):
        data = rng.integers(0, alphabet, 700).astype(np.uint8)
        raw = data.tobytes()
        assert suffix_array(data, 700).tolist() == sorted(range(700), key=lambda i: raw[i:])


def without_repeats(texts, length):
    counts = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if counts[t[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeated_strings_of_the_table(spark, docs):
    expected = dict(zip([d.doc_id for d in docs], without_repeats([d.text.encode() for d in docs], 200)))
    for r in result(spark, "op8_suffix_array"):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected.pop(r.doc_id)
    assert not expected


@pytest.mark.parametrize("crowd", [1, 1024])
def test_repeated_strings_at_many_borders(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé ", k=rng.randint(2, 9))) for _ in range(300)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    passages = [some(60) for _ in range(3)]
    texts = []
    for _ in range(60):
        p = rng.choice(passages)
        a = rng.randint(0, 100)
        texts.append(some(rng.randint(0, 40)) + p[a : rng.randint(a + 50, len(p))] + some(rng.randint(0, 40)))
    texts += ["a" * 900, "ab" * 300, "a" * 150, texts[3], "to " * 400 + some(5)]
    raw = [t.encode() for t in texts]
    rows = substrings.remove_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    expected = without_repeats(raw, 200)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] for r in rows)


def test_language_model_scores(spark, docs):
    tokens = {d.doc_id: BLANK.findall(lower(d.text)) + [" "] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = result(spark, "op9_language_model")
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_gradients_and_probabilities_of_the_recurrent_model():
    rng = np.random.default_rng(10)
    model = GruModel(np.array([9.0, 7, 5, 3, 2, 2, 1, 1]), np.array([3.0, 4.0]), classes=3, hidden=5)
    model.parameters = {k: v.astype(np.float64) for k, v in model.parameters.items()}
    ids, goal, mask = rng.integers(0, 10, (5, 3)), rng.integers(0, 10, (5, 3)), rng.random((5, 3)) < 0.8
    state = rng.normal(size=(3, 5)).astype(np.float32)
    loss = lambda: -model.window(ids, goal, mask, state, False)[0].sum() / mask.sum()
    grads = model.window(ids, goal, mask, state, True)[2]
    for name, values in model.parameters.items():
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in values.shape)
            old, step = values[at], 1e-2
            values[at] = old + step
            up = loss()
            values[at] = old - step
            down = loss()
            values[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))
    # What may follow sums to one, whatever came before.
    total = sum(math.exp(score_texts(model, [np.array([4, 8, w])], lanes=2, steps=2)[0] - score_texts(model, [np.array([4, 8])], lanes=2, steps=2)[0]) for w in range(10))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_state_is_carried_and_lanes_do_not_matter():
    rng = np.random.default_rng(11)
    model = GruModel(np.arange(20.0, 0, -1), np.ones(2), classes=4, hidden=6)
    texts = [rng.integers(0, 22, rng.integers(1, 90)) for _ in range(15)]
    Trainer(model).learn(texts, lanes=4, steps=8)
    whole = [score_texts(model, [t], lanes=1, steps=200)[0] for t in texts]
    assert np.allclose(score_texts(model, texts, lanes=4, steps=7), whole, rtol=1e-3)


def test_quality_rules(spark, docs):
    text = {d.doc_id: d.text for d in docs}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = result(spark, "op10_quality_rules")
    for r in rows:
        t = text[r.doc_id]
        words = BLANK.findall(t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(k for k, q in judged if q == 1) and sum(k for k, q in judged if q == 0) <= 2


def test_quality_rules_as_in_sql(spark):
    from oracle import compare, database

    assert compare(catalogue.QUERIES["op10_quality_rules"](spark, SF), database(SF), catalogue.ORACLE["op10_quality_rules"]) == []


def shingles(text):
    words = BLANK.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    """Each stage against a plain version on what the one before it kept."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    step, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, SF).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(step.collect())
    good = {r.doc_id for r in kept[0]}
    assert np.mean([i in good for i, q in labels.items() if q == 1]) >= 0.97
    own = {r.doc_id: shingles(r.text) for r in kept[0]}
    left = {r.doc_id for r in kept[1]}
    pairs = [(a, b, len(own[a] & own[b]) / len(own[a] | own[b])) for a in own for b in own if a < b]
    assert not [p for p in pairs if p[2] >= 0.85 and p[0] in left and p[1] in left]
    close = {i for a, b, j in pairs if j >= 0.6 for i in (a, b)}
    assert not [i for i in own if i not in left and i not in close]
    plain = dict(zip([r.doc_id for r in kept[1]], without_repeats([r.text.encode() for r in kept[1]], 200)))
    assert {r.doc_id for r in kept[2]} == left
    for r in kept[2]:
        assert 0 <= len(r.text.encode()) - (plain[r.doc_id][0] - plain[r.doc_id][1]) <= 8 * plain[r.doc_id][2]
    words = {r.doc_id: Counter(BLANK.findall(r.text)) for r in kept[2]}
    assert all(not Counter(BLANK.findall(r.text)) - words[r.doc_id] for r in kept[3])
    assert max(Counter(r.doc_id for r in kept[3]).values()) <= 3
    assert Counter((r.doc_id) for r in kept[4] if r.piece == 0) == Counter(r.doc_id for r in kept[3])


def test_words_of_runs_are_looked_up_once(monkeypatch):
    """Words as ``bytes.split`` cuts them, row by row, over runs and pieces of long texts; a run asks for each of its words once."""
    monkeypatch.setattr(scoring, "CUT_BYTES", 40)
    odd = [b" A\x0bb \x0c\xc2\x85c\x1cD \r\n", b"", b"  ", "Äß ÄSS  x".encode(), b"\xff\xfe B", b"one two one " * 30, b"tail end"]
    split = [t.lower().split() for t in odd]
    found: list[list[bytes]] = [[] for _ in odd]
    for rows, words in scoring.words_of(pa.array(odd, pa.binary())):
        for row, word in zip(rows, words.view(pa.binary()).to_pylist()):
            found[row].append(word)
    assert found == split

    class Asked(dict):
        n = 0

        def get(self, *key):
            Asked.n += 1
            return super().get(*key)

    monkeypatch.setattr(scoring, "CUT_BYTES", 1 << 20)
    known = Asked({scoring.END: 0, b"one": 1})
    vocabulary = scoring.Vocabulary(known, np.array([9, 5]), np.array([0, 1]), np.ones(scoring.RARE), 14, 2)
    runs = list(vocabulary.encode(pa.array(odd, pa.binary())))
    assert Asked.n == len({w for own in split for w in own})
    rare = lambda w: scoring.WORDS + scoring.rare_class(w)
    assert [t.tolist() for t in vocabulary.sequences(len(odd), runs)] == [[1 if w == b"one" else rare(w) for w in own] + [0] for own in split]
    others = Counter()
    for run in runs:
        for row, pair in zip(*(x.tolist() if hasattr(x, "tolist") else x for x in run.others())):
            others[row, pair["word"]] += pair["times"]
    assert others == Counter((i, w) for i, own in enumerate(split) for w in own if w != b"one")


def test_output_layer_near_the_range_of_floats():
    """Weights whose exponentials overflow give what shifted rows give; stretched windows score as plain ones."""
    rng = np.random.default_rng(12)
    model = GruModel(np.arange(20.0, 0, -1), np.ones(2), classes=4, hidden=6)
    states, goal = np.ones((9, 7), np.float32), np.sort(rng.integers(0, 22, 9))
    plain, shifted = model._output(states, goal, True), model._output(states, goal, True, True)
    assert np.allclose(plain[0], shifted[0], rtol=1e-5) and np.allclose(plain[1], shifted[1], atol=1e-6)
    model.parameters["o"] += 200
    model.parameters["p"] += 200
    far = model._output(states, goal, True)
    assert np.allclose(far[0], plain[0], rtol=1e-3) and all(np.isfinite(g).all() for g in far[2].values())
    texts = [rng.integers(0, 22, n) for n in (70, 3, 1, 9)]
    plain, wide = (list(windows(texts, model.start, 2, 8, stretched=s)) for s in (False, True))
    assert len(wide) < len(plain) and sum(int(w[4].sum()) for w in wide) == sum(int(w[4].sum()) for w in plain) == 83

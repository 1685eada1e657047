"""Operators do the whole job: each test fails on a version that left part of it out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtime.llm import common, language, scoring, simhash, substrings
from leadtime.llm.language import identify_languages, words_of
from leadtime.llm.mixing import mix, taken
from leadtime.llm.quality_rules import clean, quality_rules
from leadtime.llm.sharding import even_tree, shard_documents
from leadtime.llm.simhash import keep_one, wide_groups
from leadtime.llm.substrings import remove_repeated


def test_every_training_text_is_learnt_from_once(spark):
    texts = [f"w{i % 7} follows w{i % 5} here\nline {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learnt = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("bytes"))
    vocabulary, told = scoring._vocabulary(scoring.word_counts(learnt))
    model, tokens = scoring.train(learnt, vocabulary, told)
    assert tokens == vocabulary.tokens == sum(len(t.split()) + 1 for t in texts)
    # Texts of the last part alone teach something too.
    last = learnt.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(8)) == 7)
    alone, some = scoring.train(last, vocabulary, told)
    start = scoring._new_model(told, vocabulary.rare_sums)
    assert some and any((alone.parameters[k] != start.parameters[k]).any() for k in start.parameters)


def test_lines_above_a_mebibyte_are_judged(spark):
    filler = " ".join(f"word{i}" for i in range(120_000))
    texts = {"boilerplate": f"{filler} click here to go on.", "navigation": " | ".join(filler.split()), "punctuation": filler}
    for verdict, text in texts.items():
        assert len(text) > 1 << 20
        cleaned, facts = clean(text.encode())
        assert (cleaned, facts[verdict], facts["kept_words"]) == ("", 1, 0)
    rows = quality_rules(spark.createDataFrame([*texts.items(), ("good", f"{filler}.")], "doc_id string, text string")).collect()
    assert {r.doc_id for r in rows if r.kept} == {"good"}


def with_shared(rng, size, shared):
    """Two texts of ``size`` words whose five-word shingle sets have ``shared`` in common: one begins otherwise."""
    words = [f"w{rng.random()}" for _ in range(size)]
    own = size - 4 - shared
    return " ".join(words), " ".join([f"v{rng.random()}" for _ in range(own)] + words[own:])


def test_only_shingle_sets_at_the_similarity_are_linked(spark):
    rng, rows = random.Random(5), []
    # Of 180 shingles each: 160 in common are 0.8; 158 are 0.782; 150 are 0.714.
    for shared in (160, 158, 150):
        for _ in range(100):
            rows += [(len(rows) + i, text) for i, text in enumerate(with_shared(rng, 184, shared))]
    # Eight words against nine: four of five shingles.
    for _ in range(100):
        words = [f"w{rng.random()}" for _ in range(9)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:8]))]
    # Each text is near the next one only; the chain is one group.
    words = [f"w{rng.random()}" for _ in range(400)]
    chain = len(rows)
    rows += [(chain + i, " ".join(words[10 * i : 10 * i + 204])) for i in range(15)]
    found = {r.doc_id: r.similar_id for r in wide_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [sum(found.get(2 * i + 1) == 2 * i for i in range(k, k + 100)) for k in (0, 100, 200, 300)]
    assert linked[0] >= 95 and linked[1:3] == [0, 0] and linked[3] >= 97
    assert {found.get(chain + i) for i in range(15)} == {chain}
    assert all(root == i or i - root == 1 or i >= chain for i, root in found.items())


def test_short_foreign_spans_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND n_chars > 300")
    known = [(r.lang, [w for some in words_of(r.text) for w in some]) for r in docs.orderBy("doc_id").collect()]
    rng, rows, own = random.Random(9), [], []
    for i in range(400):
        (lang, words), (other, quoted) = rng.sample(known, 2)
        if lang == other or min(len(words), len(quoted)) < 40:
            continue
        at, start = rng.randrange(10, len(words) - 10), rng.randrange(len(quoted) - 3)
        rows.append((i, " ".join(words[at - 10 : at] + quoted[start : start + 3] + words[at : at + 10])))
        own.append((i, other))
    found = identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), docs.select("text", "lang")).collect()
    spans = {r.doc_id: r.spans for r in found}
    told = sum(any(s.lang == other for s in spans[i]) for i, other in own) / len(own)
    assert len(own) > 100 and told >= 0.98


def test_stretches_change_nothing(monkeypatch):
    """A text above two megacharacters, and many with short stretches, give the path of the whole text."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, langs = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        scores = np.where(rng.random((n, langs)) < 0.1, -np.inf, -rng.exponential(6, (n, langs)).astype(np.float32).round(1))
        whole = language.viterbi(scores, 12.0)
        cuts = np.unique([0, *rng.integers(0, n, 4), n])
        parts = [scores[a:b] for a, b in zip(cuts, cuts[1:])]
        found = dict(language.traced(len(parts), parts.__getitem__, 12.0))
        assert (np.concatenate([found[i] for i in range(len(parts))]) == whole).all()
    words = ["".join(rng.choice(list("abcdefg"), int(rng.integers(1, 9)))) for _ in range(400_000)]
    text = " ".join(words) + " " + "x" * 3000
    assert len(text) > 1 << 21
    whole = [w for some in language.words_of(text) for w in some]
    assert whole == [*words, "x" * 3000]
    for stretch in (50, 1000):
        monkeypatch.setattr(language, "STRETCH", stretch)
        assert [w for some in language.words_of(text[:100_000] + "x" * 5000 + " end") for w in some] == language.LETTERS.findall(text[:100_000] + "x" * 5000 + " end")


def test_unlike_texts_of_one_id_stay(spark):
    """Documents are told by id and text: only the near copy goes, whatever shares its id."""
    rng = random.Random(8)
    one, other = ([f"w{rng.random()}" for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(one), "b"), (1, " ".join(one), "a"), (1, " ".join(other), "c"), (2, " ".join([*one[:-1], "changed"]), "d"), (2, "quite another text of its own", "e"), (2, None, "f")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()
    assert sorted((r.doc_id, r.more) for r in kept) == [(1, "a"), (1, "c"), (2, "e"), (2, "f")]


def test_links_of_a_group_are_fewer_than_its_texts(spark, monkeypatch):
    told = []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda rows, **how: told.append(real(rows, **how)) or told[-1])
    base = [f"w{i}" for i in range(200)]
    for n in (300, 900):
        rows = [(i, " ".join([*base[: i % 200], f"x{i}", *base[i % 200 + 1 :]])) for i in range(n)]
        found = wide_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(found) == n and {r.similar_id for r in found} == {0}
        assert told[-1].count() <= n + 10


@pytest.mark.parametrize("compared", [4, 16, 256])
def test_links_are_those_of_all_pairs(spark, monkeypatch, compared):
    """Groups cut into blocks, with parts that are similar across blocks only, are tied as by comparing all pairs."""
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng, rows = random.Random(12), []
    for group in range(3):
        line = [f"g{group}w{i}" for i in range(400)]
        # Windows over one long line: near ones are similar, far ones are not; a few unlike texts are candidates too.
        rows += [(group, len(rows) + i, " ".join(line[at : at + 100])) for i, at in enumerate(rng.sample(range(300), 40))]
        rows += [(group, len(rows) + i, " ".join(f"{rng.random()}" for _ in range(30))) for i in range(5)]
    node = F.struct(F.col("id"), F.lit(0).cast("long").alias("hash"))
    df = spark.createDataFrame(rows, "grp long, id long, text string").select(node.alias("node"), F.struct(F.col("grp").alias("id"), F.lit(0).cast("long").alias("hash")).alias("root"), F.col("text").cast("binary").alias("text"))
    links = [(r.a.id, r.b.id) for r in simhash.near_links(simhash.written(df), width=5, similarity=0.8).collect()]
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for _, i, t in rows}
    near = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]

    def components(pairs):
        root = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert near and components(links) == components(near)


def test_pairs_about_the_border_of_short_texts_are_found(spark):
    """Texts of 24 to 31 shingles against copies with one word less or more: the last are at 0.8 and above."""
    rng, rows = random.Random(31), []
    for size in range(24, 32):
        for _ in range(40):
            words = [f"w{rng.random()}" for _ in range(size + 4)]
            more = [*words, *[f"v{rng.random()}" for _ in range(rng.randint(1, int(size / 4)))]]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(more))]
    found = {r.doc_id: r.similar_id for r in wide_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found.get(i + 1) == i for i in range(0, len(rows), 2)) >= 0.98 * len(rows) / 2


def test_equal_rows_have_one_set_of_runs(spark):
    """Many equal rows beside one that shares a passage: as many runs as two texts have, whatever the rows."""
    rng = random.Random(13)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, copied = some(60), some(1200)
    texts = [copied + " " + passage] * 600 + [passage + " " + some(50), some(300)]
    ids = [7] * 600 + [8, 9]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(8)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("bytes"))
    runs = {r.doc_id: r.runs for r in substrings.repeated_runs(keyed, 200).collect()}
    assert set(runs) == {7, 8} and len(runs[7]) <= 2 * len(copied)
    rows = remove_repeated(docs).collect()
    assert len(rows) == 602
    for r in rows:
        gone = {7: len(texts[0]), 8: len(passage), 9: 0}[r.doc_id]
        assert gone <= r.n_removed <= gone + (r.doc_id == 8) and (r.n_spans == (gone > 0))


@pytest.mark.parametrize("most", [0, 1 << 12])
def test_long_pieces_of_one_name_are_cut_finer(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "CROWD_BYTES", most)
    monkeypatch.setattr(substrings, "HELD", 100)
    texts = ["ab" * 3000, "ab" * 2500 + "c" * 250, "abc" * 1500, "xyz" + "abc" * 60, "d" * 199 + "e" * 199]
    rows = remove_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    counts = {}
    for t in texts:
        for s in range(len(t) - 199):
            counts[t[s : s + 200]] = counts.get(t[s : s + 200], 0) + 1
    for r in rows:
        t = texts[r.doc_id]
        gone = {i for s in range(len(t) - 199) if counts[t[s : s + 200]] > 1 for i in range(s, s + 200)}
        assert (r.n_bytes, r.n_removed) == (len(t), len(gone))


def test_equal_rows_are_placed_in_steps(spark, monkeypatch):
    monkeypatch.setattr(common, "STEP", 7)
    rows = [(1, "five words to be taken", "a")] * 40 + [(i, "one two three", "b") for i in range(2, 30)] + [(None, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix(docs, block_words=4)
    placed = mixed.rows.where("size > 0").collect()
    assert len({(r["rank"], r["start"]) for r in placed}) == 68
    assert sorted(r["copy"] for r in placed if r["doc_id"] == 1) == list(range(1, 41))
    got = taken(mixed).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    shards = shard_documents(docs, even_tree(4)).collect()
    assert len(shards) == len(rows)
    for n in range(4):
        assert sorted(r.slot for r in shards if r.shard == n) == list(range(sum(r.shard == n for r in shards)))

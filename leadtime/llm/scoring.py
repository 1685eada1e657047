"""Language-model scores of whole documents: counts of all words, and a recurrent model trained where the data lie."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import text_pieces, written
from leadtime.llm.gru import GruModel, Trainer, score_texts
from leadtime.llm.resampling import kth_largest

#: The token at the end of every text; no word holds a blank.
END = b" "
#: Words whose counts every task holds; the others meet theirs in a join.
FREQUENT = 1 << 17
#: Words that the model tells apart, and classes of all rarer ones, by how they end.
WORDS, RARE = 2048, 64
#: Words that a task counts before it passes them on; tokens that it scores at a time; bytes of texts that it cuts into words at a time.
COUNTED, SCORED, CUT_BYTES = 2_000_000, 1_500_000, 4 << 20


#: Weights that travel as one value.
PART = 4096


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Lower-cased (A-Z) words of binary texts and, for each, the row of its text, in runs from texts of bounded length; ends are left out."""
    sizes, start = pc.binary_length(texts).to_numpy(), 0
    while start < len(texts):
        if sizes[start] > CUT_BYTES:
            runs, end = (pa.array([piece], pa.binary()) for piece in text_pieces(texts[start].as_py())), start + 1
        else:
            end = start + max(1, int(np.searchsorted(sizes[start:].cumsum(), CUT_BYTES, side="right")))
            runs = iter([texts.slice(start, end - start)])
        for run in runs:
            # The ASCII blanks of Arrow are those of ``bytes.split``; beside leading and trailing ones it finds empty words.
            cut = pc.ascii_split_whitespace(pc.ascii_lower(run.view(pa.string())))
            words, rows = cut.flatten(), np.repeat(np.arange(start, start + len(run), dtype=np.int32), pc.list_value_length(cut).to_numpy())
            some = pc.greater(pc.binary_length(words), 0)
            yield rows[some.to_numpy(zero_copy_only=False)], words.filter(some)
        start = end


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all rows of ``bytes``, ends included; a task adds up its own words first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in batches:
            ends += len(batch)
            for _, words in words_of(batch.column(0)):
                held.append(words)
                size += len(words)
                if size > COUNTED:
                    yield _pairs(held)
                    held, size = [], 0
        if held:
            yield _pairs(held)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    def _pairs(held: list[pa.Array]) -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.string()))
        return pa.RecordBatch.from_arrays([found.field("values").view(pa.binary()), found.field("counts")], ["word", "n"])

    return texts.select("bytes").mapInArrow(of, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Encoded:
    """Words of texts: row, model id, place in the counts (-1: not frequent) and place in ``distinct`` of each."""

    rows: np.ndarray
    ids: np.ndarray
    places: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    def others(self) -> tuple[np.ndarray, pa.Array]:
        """Rows and entries of the words that are not frequent, a word and how often the row has it."""
        rare = np.flatnonzero(self.places < 0)
        pairs, times = np.unique(self.rows[rare].astype(np.int64) * len(self.distinct) + self.codes[rare], return_counts=True)
        size = max(1, len(self.distinct))
        words = self.distinct.take(pa.array(pairs % size)).view(pa.binary())
        return pairs // size, pa.StructArray.from_arrays([words, pa.array(times.astype(np.int64))], ["word", "times"])


@dataclass
class Vocabulary:
    """Frequent words with model id and count, logs of the rare classes' sums, and the totals."""

    ids: dict[bytes, int]
    counts: np.ndarray
    model_ids: np.ndarray
    rare_sums: np.ndarray
    tokens: int
    distinct: int

    def encode(self, texts: pa.Array) -> Iterator[Encoded]:
        """Words of binary texts in runs, ends left out; the words of a run are looked up once each."""
        for rows, words in words_of(texts):
            told = words.dictionary_encode()
            known = told.dictionary.view(pa.binary()).to_pylist()
            place = np.fromiter((self.ids.get(w, -1) for w in known), np.int32, len(known))
            other = np.flatnonzero(place < 0)
            model = self.model_ids[place]
            model[other] = [WORDS + rare_class(known[i]) for i in other]
            codes = told.indices.to_numpy()
            yield Encoded(rows, model.astype(np.int16)[codes], place[codes], codes, told.dictionary)

    def sequences(self, count: int, runs: list[Encoded]) -> list[np.ndarray]:
        """Model ids of each of ``count`` texts, the end included."""
        end = np.array([self.model_ids[self.ids[END]]], np.int16)
        rows, ids = (np.concatenate([a, *(getattr(r, k) for r in runs)]) for a, k in ((np.zeros(0, np.int64), "rows"), (end[:0], "ids")))
        cuts = np.searchsorted(rows, np.arange(count + 1)).tolist()
        return [np.concatenate([ids[a:b], end]) for a, b in zip(cuts, cuts[1:])]


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the counts of the model's words in order of their ids."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    bound = kth_largest(counts, "n", FREQUENT) if totals[1] > FREQUENT else 0
    rows = {r[0]: r[1] for r in map(tuple, counts.where((F.col("n") > bound) | (F.col("word") == F.lit(END))).collect())}
    rows = {bytes(w): n for w, n in rows.items()}
    rows.setdefault(END, 0)
    order = sorted(rows, key=lambda w: (w != END, -rows[w], w))
    told = sorted(order[:WORDS], key=lambda w: (-rows[w], w))
    order = told + order[WORDS:]
    model_ids = np.array([i if i < len(told) else WORDS + rare_class(w) for i, w in enumerate(order)], np.int64)
    sums = np.ones(RARE)
    for w in order[len(told) :]:
        sums[rare_class(w)] += rows[w] + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(RARE, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own[rare_class(word)] += n + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(own)], ["class", "n"])

    others = counts.where((F.col("n") <= bound) & (F.col("word") != F.lit(END))).mapInArrow(of, "class long, n long")
    for r in others.groupBy("class").agg(F.sum("n")).collect():
        sums[r[0]] += r[1]
    known = np.array([rows[w] for w in order], np.int64)
    vocabulary = Vocabulary({w: i for i, w in enumerate(order)}, known, model_ids, sums, totals[0] or 0, totals[1])
    return vocabulary, known[: len(told)]


def _new_model(counts: np.ndarray, rare_sums: np.ndarray) -> GruModel:
    """A model whose word ids end at ``WORDS``; where there are fewer words, the ids above them stand for nothing."""
    return GruModel(np.concatenate([counts, np.full(WORDS - len(counts), -1.0 + 1e-9)]), rare_sums)


def train(texts: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, *, rounds: int = 8) -> tuple[GruModel, int]:
    """The model after ``rounds`` of training in every task on its own texts and averaging the weights by tokens,
    and the tokens learnt from.

    Round r takes the texts whose hash modulo ``rounds`` is r, so every text is learnt from once. All
    tasks start a round from the same weights, so their units stay comparable.
    """
    context = texts.sparkSession.sparkContext
    model, learnt = _new_model(counts, vocabulary.rare_sums), 0
    words = context.broadcast(vocabulary)
    schema = "at long, value binary, tokens long"

    def rows_of(rows: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        at, values, tokens = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array([v.tobytes() for v in values]), pa.array(tokens)], ["at", "value", "tokens"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for at, value, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                before, n = sums.get(at, (0.0, 0))
                sums[at] = before + np.frombuffer(value), n + tokens
        if sums:
            yield rows_of([(at, *both) for at, both in sums.items()])

    for number in range(rounds):
        sent = context.broadcast(model)

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _new_model(counts, words.value.rare_sums)
            own.parameters = {k: v.copy() for k, v in sent.value.parameters.items()}
            trainer = Trainer(own)
            held: list[np.ndarray] = []
            size = 0

            def learn() -> None:
                # Longest first, so that lanes end together and windows stay full.
                trainer.learn(sorted(held, key=len, reverse=True))
                held.clear()

            for batch in batches:
                for text in words.value.sequences(len(batch), list(words.value.encode(batch.column(0)))):
                    held.append(text)
                    size += len(text)
                    if size >= SCORED:
                        learn()
                        size = 0
            learn()
            if trainer.tokens:
                at = range(0, len(trainer.weights), PART)
                yield rows_of([(i, trainer.weights[i : i + PART].astype(np.float64) * trainer.tokens, trainer.tokens) for i in at])

        some = texts.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(rounds)) == number).select("bytes")
        found = some.mapInArrow(of, schema).repartition("at").mapInArrow(added, schema).toArrow().sort_by("at").to_pydict()
        if not found["at"]:
            continue
        learnt += found["tokens"][0]
        flat = np.concatenate([np.frombuffer(value) / n for value, n in zip(found["value"], found["tokens"])])
        at = 0
        for k, old in model.parameters.items():
            model.parameters[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
    return model, learnt


def score_documents(docs: DataFrame, training: DataFrame, *, rounds: int = 8) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs``.

    Tokens are words and one end. ``base_score`` is the log10 probability by smoothed counts of all
    texts of ``training``; ``score`` that by the recurrent model, which learns from each of them once, over the whole text with its state
    carried on. A rare word has the probability of its class given the state, times its smoothed
    share of the class, so both are probabilities over the same tokens, one for all unseen words
    in the first, one to a class in the second. Null and empty texts are scored as one end. Without
    training texts the base gives every token probability 1. Repeated rows give repeated results;
    other columns are ignored.
    """
    texts = lambda df: df.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    learnt = texts(training)
    counts = written(word_counts(learnt))
    vocabulary, told = _vocabulary(counts)
    model, _ = train(learnt, vocabulary, told, rounds=rounds)
    context = docs.sparkSession.sparkContext
    words, sent = context.broadcast(vocabulary), context.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = words.value, sent.value
        logs = np.log10(known.counts + 1.0)
        # A rare word: what its class's share takes off, and, if frequent, what its count adds.
        rest = np.where(known.model_ids >= WORDS, logs, 0.0)
        sums = np.log10(known.rare_sums)
        end = known.ids[END]

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, runs = len(batch), list(known.encode(batch.column(2)))
            texts = known.sequences(n, runs)
            score = score_texts(model, texts) / np.log(10)
            logged, seen = np.full(n, logs[end]), np.full(n, int(known.counts[end] > 0))
            holders, others = [np.zeros(0, np.int64)], [pa.array([], pa.struct([("word", pa.binary()), ("times", pa.int64())]))]
            for run in runs:
                frequent, rare = run.places >= 0, run.ids >= WORDS
                rows, places = run.rows[frequent], run.places[frequent]
                logged += np.bincount(rows, logs[places], n)
                seen += np.bincount(rows[known.counts[places] > 0], minlength=n)
                score += np.bincount(rows, rest[places], n) - np.bincount(run.rows[rare], sums[run.ids[rare] - WORDS], n)
                for into, some in zip((holders, others), run.others()):
                    into.append(some)
            cuts = np.searchsorted(np.concatenate(holders), np.arange(n + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(cuts), pa.concat_arrays(others))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, *map(pa.array, (seen, logged, score)), listed], names)

        for batch in batches:
            # Rows of about as many tokens as are scored at a time.
            weight = pc.binary_length(batch.column(2)).to_numpy().cumsum() // (6 * SCORED)
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(batch)]
            for first, last in zip(cuts, cuts[1:]):
                if first < last:
                    yield scored(batch.slice(first, last - first))

    names = ["doc_id", "text_hash", "n_tokens", "n_frequent", "logs", "score", "others"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_tokens long, n_frequent long, logs double, score double, others array<struct<word: binary, times: bigint>>"
    scored = written(texts(docs).mapInArrow(of, schema))
    others = scored.select("doc_id", "text_hash", F.explode("others").alias("o")).select("doc_id", "text_hash", "o.word", "o.times")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)
    met = others.join(counts, "word", "left").groupBy("doc_id", "text_hash").agg(
        F.sum(log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen")
    )
    # Equal rows were added up together.
    equal = scored.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rows = scored.drop("others").alias("l")
    for side in (met, equal):
        right = side.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
        rows = rows.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").drop("__id", "__hash")
    more = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    size = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce((F.col("seen") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * size).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )

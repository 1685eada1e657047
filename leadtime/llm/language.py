"""Language of texts that may mix several: script ranges, scores per word, Viterbi over the words."""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
#: Distinct words that a task holds before it turns them into counts, or a worker remembers scores of.
REMEMBERED = 400_000
#: Characters of a text that are split into words, scored and traced at once; words are never cut.
STRETCH = 1 << 20

# First code point of ranges of letters and the script they belong to.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFF00, "other"),
    (0x20000, "han"),
]
_STARTS = [start for start, _ in SCRIPTS]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def script(word: str) -> str:
    """Script of a word's first letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def stretches(text: str) -> list[tuple[int, int]]:
    """Where to cut a text into stretches of about ``STRETCH`` characters: after blanks or full stops, never inside a word."""
    cuts, start = [], 0
    while start < len(text):
        end = start + STRETCH
        if end < len(text):
            back = max((text.rfind(c, start, end) for c in _BREAKS), default=-1)
            ahead = [i for i in (text.find(c, end) for c in _BREAKS) if i >= 0] if back < 0 else []
            end = back + 1 if back >= 0 else min(ahead) + 1 if ahead else len(text)
        cuts.append((start, min(end, len(text))))
        start = end
    return cuts


#: After these a text can be cut without a change of its words or of their lower case.
_BREAKS = " \n\t\u3000\u3002"


def words_of(text: str) -> Iterator[list[str]]:
    """Runs of letters, lower case, whole; a very long text comes in stretches."""
    for start, end in stretches(text):
        yield LETTERS.findall(text[start:end].lower())


def features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word itself and of its runs of one to three letters, ends marked, one word after the
    other; and where each word's buckets begin."""
    framed = "".join([f"\x02{w}\x03" for w in words])
    points = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inside = points != 3
    begins = np.flatnonzero(points == 2)
    of_word = np.cumsum(points == 2) - 1
    ahead = np.concatenate([points, np.zeros(2, np.uint64)])
    one, two, three = ahead[:-2], ahead[1:-1], ahead[2:]
    pairs = inside
    triples = inside & np.concatenate([inside[1:], [False]])
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    mixed = [own * _MIX[0], (one * _MIX[1])[pairs], (one * _MIX[2] + two * _MIX[3])[pairs], (one * _MIX[4] + two * _MIX[5] + three * _MIX[6])[triples]]
    owner = np.concatenate([np.arange(len(begins)), of_word[pairs], of_word[pairs], of_word[triples]])
    order = np.argsort(owner, kind="stable")
    hashes = np.concatenate(mixed)[order]
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MIX[7]
    buckets = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return buckets, np.searchsorted(owner[order], np.arange(len(begins)))


#: Odd factors of the letters' places.
_MIX = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(8)]


def language_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``kind``, ``bucket`` and ``n`` over all rows whose ``lang`` and ``text`` are not null.

    Kind 0 counts features, kind 1 letters by script. A task adds up its own counts first.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        words: dict[str, Counter] = {}

        def fold() -> None:
            for lang, seen in words.items():
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                for word, n in seen.items():
                    scripts[lang, SCRIPT_NAMES.index(script(word))] += n * len(word)
                own = list(seen)
                for start in range(0, len(own), 20_000):
                    some = own[start : start + 20_000]
                    buckets, begins = features(some)
                    times = np.repeat([seen[w] for w in some], np.diff(begins, append=len(buckets)))
                    counts[lang] += np.bincount(buckets, times, BUCKETS).astype(np.int64)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for some in words_of(text.as_py()):
                    words.setdefault(lang, Counter()).update(some)
            if sum(map(len, words.values())) > REMEMBERED:
                fold()
        fold()
        for lang, found in counts.items():
            full = np.flatnonzero(found)
            rows = [(0, int(b), int(found[b])) for b in full] + [(1, s, n) for (of_lang, s), n in scripts.items() if of_lang == lang]
            kind, bucket, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(rows), pa.string()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())],
                ["lang", "kind", "bucket", "n"],
            )

    known = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return known.mapInArrow(of, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities of features by language, and the languages that a script can mean."""

    def __init__(self, rows: list[tuple[str, int, int, int]], smoothing: float = 0.5, least_share: float = 0.001):
        self.languages = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.languages)}
        counts = np.zeros((BUCKETS, len(place)))
        letters = np.zeros((len(SCRIPT_NAMES), len(place)))
        for lang, kind, bucket, n in rows:
            (letters if kind else counts)[bucket, place[lang]] = n
        self.weights = np.log((counts + smoothing) / (counts.sum(0) + smoothing * BUCKETS)).astype(np.float32)
        self.written_in = letters >= least_share * np.maximum(letters.sum(0), 1)

    def score(self, words: Sequence[str]) -> np.ndarray:
        """Relative scores by word and language: 0 for the best, minus infinity where the script rules one out.

        A word in a script of no learned language says nothing.
        """
        buckets, begins = features(words)
        scores = np.add.reduceat(self.weights[buckets], begins, axis=0)
        candidates = self.written_in[[SCRIPT_NAMES.index(script(w)) for w in words]]
        scores = np.where(candidates, scores, -np.inf)
        best = scores.max(1, keepdims=True)
        return np.where(np.isfinite(best), scores - np.where(np.isfinite(best), best, 0), 0).astype(np.float32)


class ScoredWords:
    """Scores of the words that a worker has met with one model; a full memory is emptied between texts."""

    def __init__(self, model: LanguageModel):
        self.model, self.place = model, {}
        self.table = np.zeros((REMEMBERED, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        found = list(map(self.place.get, words))
        if None in found:
            new = list({w for w, i in zip(words, found) if i is None})
            if len(self.place) + len(new) > REMEMBERED:
                self.place.clear()
                new = list(set(words))
            if len(new) > REMEMBERED:
                return self.model.score(words)
            start = len(self.place)
            self.table[start : start + len(new)] = self.model.score(new)
            self.place.update(zip(new, range(start, start + len(new))))
            found = list(map(self.place.get, words))
        return self.table[found]


#: The words of the model that a Python worker used last, by the model's name.
_SCORED: dict[str, ScoredWords] = {}


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word when a change of language costs ``penalty``."""
    return next(path for _, path in traced(1, lambda _: scores, penalty))


def _forward(rows: list[list[float]], state: list[float] | None, penalty: float, back: list | None = None) -> list[float]:
    """The best sum that ends in each language after ``rows``, going on from ``state``; ``back`` gets an entry per row."""
    for row in rows:
        if state is None:
            state, entry = row, None
        else:
            least, entry = max(state) - penalty, None
            if min(state) < least:
                # Languages that are reached better by a change come from the best one.
                entry = (state.index(max(state)), [s < least for s in state])
                state = [max(s, least) + x for s, x in zip(state, row)]
            else:
                state = [s + x for s, x in zip(state, row)]
        if back is not None:
            back.append(entry)
    return state


def traced(count: int, scores_of: Callable[[int], np.ndarray], penalty: float) -> Iterator[tuple[int, np.ndarray]]:
    """The best path over ``count`` stretches of one text, stretch by stretch from the last to the first.

    It is the path over the whole text: sums are carried from stretch to stretch going forward, and what each one
    began with is kept; going backward each stretch is traced anew from that, so only one is held at a time.
    If no run of words gains more than one change by leaving the best language overall, that
    one holds throughout; only other texts are traced word by word.
    """
    only = np.maximum(scores_of(0), -1e6) if count == 1 else None

    def scores(i: int) -> np.ndarray:
        return only if only is not None else np.maximum(scores_of(i), -1e6)

    best = int(sum(scores(i).sum(0, dtype=np.float64) for i in range(count)).argmax())
    run = least = most = 0.0
    sizes = []
    for i in range(count):
        own = scores(i)
        sizes.append(len(own))
        if own.shape[1] > 1 and len(own):
            gains = np.delete(own, best, axis=1).max(1).astype(np.float64) - own[:, best]
            sums = np.concatenate([[run], run + gains.cumsum()])
            lows = np.minimum(np.minimum.accumulate(sums), least)
            most, run, least = max(most, float((sums - lows).max())), float(sums[-1]), float(lows[-1])
    if most <= penalty:
        yield from ((i, np.full(sizes[i], best)) for i in reversed(range(count)))
        return
    begun, state = [], None
    for i in range(count - 1):
        begun.append(state)
        state = _forward(scores(i).tolist(), state, penalty)
    begun.append(state)
    now = None
    for i in reversed(range(count)):
        back: list = []
        ended = _forward(scores(i).tolist(), begun[i], penalty, back)
        now = ended.index(max(ended)) if now is None else now
        path = np.empty(len(back), np.int64)
        for at in range(len(back) - 1, -1, -1):
            path[at] = now
            if back[at] is not None and back[at][1][now]:
                now = back[at][0]
        yield i, path


def identify_languages(docs: DataFrame, training: DataFrame, *, penalty: float = 12.0) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` of every row of ``docs``, from its text alone.

    A change of language costs ``penalty`` nats; a span inside a text is told from twice that on. The model counts all rows of ``training`` (``text``, ``lang``) and holds ``BUCKETS`` weights per
    language. ``spans`` are the stretches of one language, with number of words. ``lang_pred`` is the
    language of most letters, the first by name if two are equal; ``score`` its share of them. Null
    texts, texts without a letter, and all texts where there is nothing to learn from, are ``und``
    with score 0 and no span. Very long texts are worked on in stretches, with the result of the whole (``traced``). Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    model = LanguageModel([tuple(r) for r in language_counts(training).collect()])
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def label(text: str | None, scored: ScoredWords) -> tuple[str, float, list[dict]]:
        languages = scored.model.languages
        if not text or not languages:
            return "und", 0.0, []
        letters, spans = np.zeros(len(languages), np.int64), []
        cuts = stretches(text)

        @lru_cache(1)
        def words(i: int) -> list[str]:
            return LETTERS.findall(text[slice(*cuts[i])].lower())

        held = [i for i in range(len(cuts)) if words(i)]
        if not held:
            return "und", 0.0, []
        for i, path in traced(len(held), lambda n: scored.of(words(held[n])), penalty):
            own = words(held[i])
            letters += np.bincount(path, np.fromiter(map(len, own), np.int64, len(own)), len(letters)).astype(np.int64)
            ends = np.flatnonzero(np.diff(path, append=-1)) + 1
            # Spans are gathered from the last to the first; one may go on over a cut.
            for s, e in reversed(list(zip([0, *ends[:-1]], ends))):
                lang = languages[path[e - 1]]
                if e == len(path) and spans and spans[-1]["lang"] == lang:
                    spans[-1]["words"] += int(e - s)
                else:
                    spans.append({"lang": lang, "words": int(e - s)})
        return languages[letters.argmax()], float(letters.max() / letters.sum()), spans[::-1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORED:
            _SCORED.clear()
            _SCORED[name] = ScoredWords(shared.value)
        scored = _SCORED[name]
        for batch in batches:
            lang, score, spans = zip(*(label(text.as_py(), scored) for text in batch.column(1))) if batch.num_rows else ((),) * 3
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang: string, words: bigint>>"
    return docs.select("doc_id", "text").mapInArrow(of, schema)


def held_out(doc_id: Column, folds: int, fold: int = 2) -> Column:
    """Whether the crc32 of the id as text falls into the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))

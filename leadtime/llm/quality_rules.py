"""Line-first cleaning: rules per line, failing lines removed, texts that lose too much rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import BLANKS, text_pieces

#: A line that stands between these is a menu, a table row or a trail of links.
SEPARATORS = frozenset([b"|", b"\xc2\xbb", b">", b">>", b"\xe2\x80\xa2", b"\xc2\xb7", b"/"])
#: One of these words alone, or only these, make a line of navigation.
NAVIGATION = frozenset(
    b"home about contact login logout register menu search sitemap next previous back top share print help faq".split()
)
BOILERPLATE = re.compile(
    rb"cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum"
    rb"|click here|sign up|subscribe to|licen[sc]ed under|copyright \d|copyright \(c\)",
    re.I,
)
#: What may end a sentence, with closing quotes and brackets.
ENDS = re.compile(rb"""(?:[.!?:;]|\xe2\x80\xa6)(?:["')\]]|\xe2\x80\x9d|\xc2\xbb)*$""")
MARKED = re.compile(rb"[#*$%&@!^~=_+\\<>|]{2,}[.,;:]?$")
SYMBOLS = rb"#*$%&|<>"


def line_verdict(words: list[bytes]) -> str | None:
    """Why a line fails: ``navigation``, ``boilerplate``, ``punctuation``; None if it may stay."""
    bars = sum(w in SEPARATORS for w in words)
    if bars >= 2 and 6 * bars >= len(words):
        return "navigation"
    if len(words) <= 8 and all(w.strip(b".,:;").lower() in NAVIGATION for w in words):
        return "navigation"
    line = b" ".join(words)
    if BOILERPLATE.search(line):
        return "boilerplate"
    if not ENDS.search(line):
        return "punctuation"
    # The last three bytes say it; a search from every byte of a very long run of marks would not end.
    if len(words) >= 4 and 2 * sum(MARKED.search(w[-3:]) is not None for w in words) > len(words):
        return "punctuation"
    return None


def _repeated(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            n += i + width - max(i, covered)
            covered = i + width
    return n


def clean(text: bytes | None) -> tuple[str, dict[str, int]]:
    """The text without its failing lines, and what was counted in it."""
    text = text or b""
    words: list[bytes] = []
    for piece in text_pieces(text):
        words += piece.split()
    seen, kept = set(), []
    facts = {"n_words": len(words), "n_dup_lines": 0, "kept_words": 0, "navigation": 0, "boilerplate": 0, "punctuation": 0}
    for line in text.split(b"\n"):
        of_line = line.split()
        if not of_line:
            continue
        if line in seen:
            facts["n_dup_lines"] += 1
        seen.add(line)
        verdict = line_verdict(of_line)
        if verdict:
            facts[verdict] += 1
        else:
            kept.append(line)
            facts["kept_words"] += len(of_line)
    points = len(text) - len(text.translate(None, _NOT_CONTINUATION))
    facts["word_chars"] = points - (len(text) - len(text.translate(None, BLANKS)))
    facts["n_symbols"] = len(text) - len(text.translate(None, SYMBOLS))
    facts["n_repeat_words"] = _repeated(words)
    return b"\n".join(kept).decode("utf-8", "replace"), facts


#: Every byte that begins a code point.
_NOT_CONTINUATION = bytes(b for b in range(256) if b & 0xC0 != 0x80)

FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "navigation", "boilerplate", "punctuation"]


def line_cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``cleaned`` (the text without failing lines) and the counts ``FACTS`` of every row of ``docs``.

    Lines of no word are neither counted nor kept. Null and empty texts have no words and clean to
    the empty text. Each row stands alone: repeated rows give repeated results, other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clean(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([facts[name] for _, facts in found], pa.int64()) for name in FACTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text for text, _ in found], pa.string()), *columns], ["doc_id", "cleaned", *FACTS]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "cleaned string", *[f"{name} long" for name in FACTS]])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(of, schema)


def quality_rules(docs: DataFrame, *, min_words: int = 10, max_repeat: int = 20, min_kept: int = 50) -> DataFrame:
    """``line_cleaned`` with ``base_failed`` and ``kept``.

    A text fails at the base if it has fewer than ``min_words`` words or more than ``max_repeat``
    per cent of them lie in repeated windows of five. It is kept if it does not, and its lines that
    pass hold at least ``min_kept`` per cent of its words.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return line_cleaned(docs).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("kept_words") >= min_kept * F.col("n_words"))
    )

"""The quality rules in DuckDB's SQL, to compare with."""

from __future__ import annotations

from leadtime.llm.quality_rules import NAVIGATION, SEPARATORS

_WORD = r"[^\x20\x09-\x0D]+"


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w.decode()}'" for w in sorted(words)) + ")"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM d),
-- Windows of five words, those found twice, and the words in them.
v AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT r, i, array_to_string(words[i : i + 4], ' ') AS five FROM v),
t AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM t, range(5) g(o) GROUP BY r),
-- Lines with a word and why they fail.
l AS (SELECT r, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) AS line FROM d),
m AS (SELECT r, line, regexp_extract_all(line, '{_WORD}') AS words FROM l),
f AS (SELECT r, line, len(words) AS n, array_to_string(words, ' ') AS said,
             len(list_filter(words, lambda x: x IN {_listed(SEPARATORS)})) AS bars,
             len(list_filter(words, lambda x: lower(trim(x, '.,:;')) IN {_listed(NAVIGATION)})) AS menu,
             len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&@!^~=_+\\\\<>|]{{2,}}[.,;:]?$'))) AS marked FROM m),
j AS (SELECT r, line, n, CASE
        WHEN bars >= 2 AND 6 * bars >= n OR n <= 8 AND menu = n THEN 'navigation'
        WHEN regexp_matches(said, 'cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript'
             || '|lorem ipsum|click here|sign up|subscribe to|licen[sc]ed under|copyright \\d|copyright \\(c\\)', 'i') THEN 'boilerplate'
        WHEN NOT regexp_matches(said, '(?:[.!?:;]|…)(?:["'')\\]]|”|»)*$') OR n >= 4 AND 2 * marked > n THEN 'punctuation'
        END AS why FROM f),
s AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(CAST(sum(n) FILTER (why IS NULL) AS BIGINT), 0) AS kept_words,
             count(*) FILTER (why = 'navigation') AS navigation, count(*) FILTER (why = 'boilerplate') AS boilerplate,
             count(*) FILTER (why = 'punctuation') AS punctuation FROM j GROUP BY r),
a AS (SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words, coalesce(navigation, 0) AS navigation,
             coalesce(boilerplate, 0) AS boilerplate, coalesce(punctuation, 0) AS punctuation
      FROM w LEFT JOIN c USING (r) LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * kept_words >= 50 * n_words AS kept FROM b"""

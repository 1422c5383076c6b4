"""Quality rules by suffix-array repetition.

For every text the words form a sequence; its suffix array and longest-common-prefix
array are built by vectorised prefix doubling, many texts at once (suffixes of different
texts never compare equal).  Neighbouring suffixes that share at least ``m`` words form
LCP intervals, whose members are the occurrences of maximal repeated substrings; the
union of their spans is the repeated part of the text.  With m = 3 that union is exactly
the set of words in 3-word windows found twice, which the base rule counts; with
m = ``MIN_REPEAT`` it is what the verdict limits, together with the longest repeat.

Every text is judged alone: one pass, no shuffle.  Memory is bounded by one slice of
about 1 MB of text (``SLICE``) or the longest single text.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows
and null ids each get their row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import table
from umbra.llm.tokens import slices, split_words

#: Repeats of this many words or more are boilerplate rather than phrases.
MIN_REPEAT = 8
#: Limits of the verdict: percent of words in such repeats, and words of the longest one.
MAX_COVERED_PERCENT = 40
MAX_REPEAT = 200
MIN_WORDS = 50
MAX_BASE_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Bytes of text measured at once; 1 MB took 33 MB of working memory (words of five letters, three texts of one long repeat).
SLICE = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat (inside its text) that starts there.

    ``codes`` are the words of all texts, ``offsets`` their bounds.
    """
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(offsets[1:], lengths)
    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank = _ranks(np.zeros(n, np.int32 if n < 1 << 31 else np.int64), order, key[order], np.arange(n))
    levels, h = [rank], 1
    open_ = order[_grouped(rank[order])]
    while len(open_):
        ahead = open_ + h
        inside = ahead < ends[open_]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        first = rank[open_]
        rank = rank.copy()
        fresh = np.empty(len(open_), bool)
        fresh[0] = True
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.empty(len(open_), bool)
        group[0] = True
        group[1:] = first[1:] != first[:-1]
        # A group of equal suffixes keeps the place of its first member in the whole order.
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(group, at, 0))
        here = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[open_] = first + (here - start)
        h *= 2
        open_ = open_[_grouped(rank[open_])]
        if len(open_):
            levels.append(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    p, q = suffixes[:-1], suffixes[1:]
    same = text[p] == text[q]
    p, q = p[same], q[same]
    lcp = np.zeros(len(p), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = p + lcp, q + lcp
        ok = (a < ends[p]) & (b < ends[q])
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        lcp[ok] += 1 << level
    np.maximum.at(longest, p, lcp)
    np.maximum.at(longest, q, lcp)
    return longest


def _ranks(rank: np.ndarray, order: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    return rank


def _grouped(rank: np.ndarray) -> np.ndarray:
    """Of ranks in order: those shared with a neighbour."""
    equal = rank[1:] == rank[:-1]
    return np.concatenate([equal, [False]]) | np.concatenate([[False], equal])


def covered(longest: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Words of each text inside repeats of ``least`` words or more (union of spans)."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    return inside[offsets[1:]] - inside[offsets[:-1]]


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines)) if len(lines) > 1 else 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    words = split_words(texts)
    longest = repeats(words.codes, words.offsets)
    strings = [x or "" for x in texts.to_pylist()]
    n_words = np.diff(words.offsets)
    longest_in = np.zeros(len(strings), np.int64)
    full = np.flatnonzero(n_words)
    if len(full):
        longest_in[full] = np.maximum.reduceat(longest, words.offsets[full])
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(x) - sum(map(x.count, BLANKS)) for x in strings], np.int64),
        "n_symbols": np.array([sum(map(x.count, SYMBOLS)) for x in strings], np.int64),
        "n_dup_lines": np.array([duplicate_lines(x) for x in strings], np.int64),
        "n_repeat_words": covered(longest, words.offsets, 3),
        "n_covered": covered(longest, words.offsets, MIN_REPEAT),
        "longest_repeat": longest_in,
    }
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_BASE_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & (100 * out["n_covered"] <= MAX_COVERED_PERCENT * n_words) & (longest_in <= MAX_REPEAT)
    return out


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


def quality(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` of every row with the measures and verdicts of its text."""
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                got = measure(batch.column("_text"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, got.values())], names=[*batch.schema.names[:-1], *got])

    return rows.mapInArrow(run, f"{fields}, {RULES}")


def keep_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text the rules keep, unchanged."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                yield batch.filter(pa.array(measure(batch.column(text_col))["kept"]))

    return docs.mapInArrow(run, fields)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), ["doc_id"]).drop("longest_repeat")


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (
  SELECT r, m, pos, count(*) OVER (PARTITION BY r, m, gram) AS n FROM (
    SELECT r, m, pos, array_to_string(w[pos:pos + m - 1], ' ') AS gram
    FROM d, (VALUES (3), ({MIN_REPEAT}), ({MAX_REPEAT + 1})) AS sizes(m), unnest(range(1, len(w) - m + 2)) AS u(pos))),
hit AS (SELECT r, m, count(DISTINCT q) AS n FROM spans, unnest(range(pos, pos + m)) AS u(q) WHERE spans.n > 1 GROUP BY r, m),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
         coalesce(h3.n, 0)::BIGINT AS n_repeat_words, coalesce(hm.n, 0)::BIGINT AS n_covered, hx.n IS NOT NULL AS too_long
  FROM d LEFT JOIN lines USING (r) LEFT JOIN hit h3 ON h3.r = d.r AND h3.m = 3
  LEFT JOIN hit hm ON hm.r = d.r AND hm.m = {MIN_REPEAT} LEFT JOIN hit hx ON hx.r = d.r AND hx.m = {MAX_REPEAT + 1})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_BASE_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_BASE_PERCENT} * n_words)
         AND 100 * n_covered <= {MAX_COVERED_PERCENT} * n_words AND NOT too_long AS kept
FROM m
"""

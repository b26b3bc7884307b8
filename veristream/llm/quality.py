"""Quality rules: repetition measured on a suffix array of each document's words.

For a slice of documents the suffix array is built by prefix doubling over words; suffixes that are already
unique leave the loop, so clean prose costs about two sorts.  Longest-common-prefix intervals of neighbouring
suffixes give, for each word, the longest repeat that starts there.  Spans of maximal repeats of at least
``MIN_REPEAT`` words are united.  A document is rejected when more than ``MAX_COVERED`` of its words lie in
such spans, or when one repeat is longer than ``MAX_REPEAT`` words.  Both limits bind below the base rule's
``BASE_MAX_PERCENT``.  Words are told apart by their bytes.  Everything is local to a document: no shuffle, and memory
grows with the longest document.

Defined results: a null text is an empty one (no words, so the base rule rejects it); repeated rows and ties are
judged one by one; an empty table gives an empty result; other columns are kept by :func:`quality_filter` and
ignored by :func:`quality_report`, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa

from . import textops as tx

MIN_REPEAT = 8
MAX_COVERED = 0.15
MAX_REPEAT = 50
#: Pairs of neighbouring suffixes that are compared at once.
PAIRS = 1 << 20
BASE_MIN_WORDS = 10
BASE_WINDOW = 5
BASE_MAX_PERCENT = 20

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
_REPORT = pa.schema([(n, pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in (c.split()[0] for c in REPORT.split(", "))])

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_NEWLINE = np.zeros(256, bool)
_IS_NEWLINE[ord("\n")] = True


def longest_repeats(symbols: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest repeat of its row that starts there.

    ``symbols`` differ between rows; ``row_end`` is the index after the last position of a row."""
    n = len(symbols)
    row_end = row_end.astype(np.int32)
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, width = [rank.copy()], 1
    active = np.flatnonzero((np.bincount(rank, minlength=n) > 1)[rank])
    while len(active):
        after = active + width
        second = np.where(after < row_end[active], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        at, first, second = active[by], rank[active[by]], second[by]
        group = np.ones(len(at), bool)
        group[1:] = first[1:] != first[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        here = np.arange(len(at))
        part_at = np.maximum.accumulate(np.where(part, here, 0))
        rank[at] = first + part_at - np.maximum.accumulate(np.where(group, here, 0))
        levels.append(rank.copy())
        active = at[np.bincount(part_at, minlength=len(at))[part_at] > 1]
        width *= 2
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    best = np.zeros(n, np.int32)
    for at in range(0, n - 1, PAIRS):
        left, right = suffixes[at : at + PAIRS], suffixes[at + 1 : at + PAIRS + 1]
        left = left[: len(right)]
        same = np.flatnonzero(levels[0][left] == levels[0][right])
        left, right = left[same], right[same]
        end, common = row_end[left], np.zeros(len(left), np.int32)
        for k in reversed(range(len(levels))):
            a, b = left + common, right + common
            fits = np.maximum(a, b) + (1 << k) <= end
            equal = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
            common += (fits & equal) * np.int32(1 << k)
        np.maximum.at(best, left, common)
        np.maximum.at(best, right, common)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the union of all repeats of at least ``least`` words."""
    at = np.flatnonzero(best >= least)
    edge = np.zeros(len(best) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: tx.Words) -> np.ndarray:
    """For each row, how many of its lines with a word equal an earlier line of it."""
    rows = len(offsets) - 1
    lines = tx.Words(data, offsets, _IS_NEWLINE)
    if not len(lines):
        return np.zeros(rows, np.int64)
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    codes, distinct = lines.codes()
    row = lines.row[has_word]
    _, first = np.unique(row.astype(np.int64) * len(distinct) + codes[has_word], return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


def assess(texts: pa.Array, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> dict[str, np.ndarray]:
    """All figures and the verdict for the texts of one slice."""
    data, offsets = tx.utf8(texts)
    rows = len(offsets) - 1
    words = tx.Words(data, offsets)
    per_row = lambda mask: np.bincount(words.row[mask], minlength=rows)
    best = np.zeros(0, np.int32)
    if len(words):
        codes, distinct = words.codes()
        best = longest_repeats(words.row.astype(np.int64) * len(distinct) + codes, words.row_end())
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row, best)
    out = {
        "n_words": words.counts,
        "word_chars": tx.row_sums(words.inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tx.row_sums(_IS_SYMBOL[data], offsets),
        "n_dup_lines": duplicate_lines(data, offsets, words),
        "n_repeat_words": per_row(covered(best, BASE_WINDOW)),
        "n_covered_words": per_row(covered(best, min_repeat)),
        "longest_repeat": longest,
    }
    n = out["n_words"]
    out["base_failed"] = (n < BASE_MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_MAX_PERCENT * n)
    out["kept"] = ~(out["base_failed"] | (out["n_covered_words"] > max_covered * n) | (longest > max_repeat))
    return out


def quality_report(docs, **limits):
    """One row of figures and a verdict for each document."""

    def run(batches):
        for part in tx.slices(batches):
            found = assess(part.column("text"), **limits)
            yield tx.batch_of(_REPORT, part.column("doc_id").cast(pa.int64()), *(found[n] for n in _REPORT.names[1:]))

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def _keep(batches, limits):
    for part in tx.slices(batches):
        yield part.filter(pa.array(assess(part.column("text"), **limits)["kept"]))


def quality_filter(docs, **limits):
    """The documents that are kept, with all their columns."""
    return docs.mapInArrow(partial(_keep, limits=limits), docs.schema)


def op2_quality_repetition(spark, sf_dir):
    return quality_report(tx.read_documents(spark, sf_dir)).drop("longest_repeat")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT r, n, i,
        CASE WHEN i + 4 <= n THEN list_aggregate(ws[i:i + 4], 'string_agg', ' ') END AS g5,
        CASE WHEN i + 7 <= n THEN list_aggregate(ws[i:i + 7], 'string_agg', ' ') END AS g8,
        CASE WHEN i + 50 <= n THEN md5(list_aggregate(ws[i:i + 50], 'string_agg', ' ')) END AS g51 FROM p),
c AS (SELECT r, n, i,
        g5 IS NOT NULL AND count(g5) OVER (PARTITION BY r, g5) > 1 AS r5,
        g8 IS NOT NULL AND count(g8) OVER (PARTITION BY r, g8) > 1 AS r8,
        g51 IS NOT NULL AND count(g51) OVER (PARTITION BY r, g51) > 1 AS r51 FROM g),
v AS (SELECT r, r51, max(r5::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v5,
        max(r8::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS v8 FROM c),
-- A repeat of over 50 words is a window of 51 words found twice.
s AS (SELECT r, sum(v5) AS n_repeat_words, sum(v8) AS n_covered_words, bool_or(r51) AS too_long FROM v GROUP BY r),
l AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dl AS (SELECT r, sum(c - 1) AS n_dup_lines FROM l GROUP BY r),
f AS (SELECT w.r, w.doc_id, len(ws)::bigint AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
        coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
        coalesce(n_covered_words, 0)::bigint AS n_covered_words, coalesce(too_long, false) AS too_long
      FROM w LEFT JOIN s USING (r) LEFT JOIN dl USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_covered_words > 0.15 * n_words OR too_long) AS kept,
  n_covered_words
FROM f
"""

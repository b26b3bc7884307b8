"""Fuzzy search for short licence notices.

Texts are reduced to lower-case words joined by single spaces.  A notice that is allowed k errors is split into k + m pieces:
a place within k errors of the notice must hold m of them unchanged (pigeonhole), nearly where they stand in the notice.  Pieces are
sought exactly in the bytes of a whole slice of documents; where m of them meet, a window of the notice's length and k more on either
side is measured in one pass of the distance table, and if some part of it is near enough, given to the regex library's
bounded-error matching, which verifies the errors and reports the span.  What tells two
licences apart (a version, a letter) stands in an exact tail.  Everything is local to a document: no shuffle.

Defined results: a null text is an empty one (no words, no labels, score 0); rows repeated under one doc_id are searched
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textops as tx


class Notice(NamedTuple):
    label: str
    #: Sought with errors, as words.
    text: str
    errors: int
    #: Must follow unchanged.
    tail: str = ""


#: The phrases whose exact places are counted.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening words of common licence notices, as their publishers word them.
NOTICES = [
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8),
    Notice("apache-2", "licensed under the apache license version ", 4, "2"),
    Notice("cc-by-nc", "licensed under cc by ", 2, "nc"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("mpl-2", "subject to the terms of the mozilla public license v ", 4, "2"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", 8),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
]

#: A word ends at ASCII characters other than 0-9 and a-z (texts are lower-cased before).
BREAK = np.ones(256, bool)
BREAK[0x30:0x3A] = BREAK[0x61:0x7B] = BREAK[0x80:] = False

SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,errors:long,score:double>>"


def needed(notice: Notice) -> int:
    """How many pieces a place must hold unchanged: up to four, of six characters or more each."""
    return max(1, min(4, len(notice.text) // 6 - notice.errors))


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """errors + needed pieces of nearly equal length that make up the notice, with their places."""
    edges = np.linspace(0, len(notice.text), notice.errors + needed(notice) + 1).round().astype(int)
    return [(int(a), notice.text[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(maxsize=64)
def _masks(pattern: str) -> dict[str, int]:
    return {c: sum(1 << k for k, x in enumerate(pattern) if x == c) for c in set(pattern)}


def near(pattern: str, errors: int, text: str) -> bool:
    """Whether some part of the text is within so many errors of the pattern: one number holds a column of the distance table."""
    masks, full, top = _masks(pattern), (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, score = full, 0, len(pattern)
    for c in text:
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(plus & top) - bool(minus & top)
        if score <= errors:
            return True
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(same | down | plus)) & full, plus & (same | down) & full
    return False


def candidates(notice: Notice, buffer: bytes, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and places of the buffer near which the notice may begin: ``needed`` of its pieces stand where up to ``errors`` edits may
    have moved them (a character put in has four bytes at most).  Of places that lie as close, the first."""
    reach = 4 * notice.errors
    begins = [np.array(places(buffer, piece.encode()), np.int64) - offset for offset, piece in pieces(notice)]
    at = np.concatenate([b + offset for b, (offset, _) in zip(begins, pieces(notice), strict=True)])
    begin, row = np.concatenate(begins), np.searchsorted(lines, at, "right") - 1
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    # Begins of one row lie within its line or up to a notice before it: rows set apart by more can be searched at once.
    place = begin + row * np.int64(len(notice.text) + reach + 1)
    enough = np.searchsorted(place, place + reach, "right") - np.arange(len(place)) >= needed(notice)
    row, begin = row[enough], begin[enough]
    keep, last = [], (-1, 0)
    for k, (r, b) in enumerate(zip(row.tolist(), begin.tolist(), strict=True)):
        if r != last[0] or b > last[1] + reach:
            keep.append(k)
            last = (r, b)
    return row[keep], begin[keep]


@lru_cache(maxsize=64)
def pattern(notice: Notice):
    """The notice at the start of a word, within its errors, with the tail up to the end of a word."""
    return regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice.text, special_only=True, literal_spaces=True)}){{e<={notice.errors}}}{regex.escape(notice.tail)}(?![^ ])")


def places(buffer: bytes, needle: bytes) -> list[int]:
    """All places of a needle, overlapping ones too."""
    out, at = [], buffer.find(needle)
    while at >= 0:
        out.append(at)
        at = buffer.find(needle, at + 1)
    return out


def scan(texts: pa.Array) -> list[dict]:
    """What is found in each text of a slice."""
    data, offsets = tx.utf8(texts)
    words = tx.Words(tx.LOWER[data], offsets, BREAK)
    rows = len(offsets) - 1
    # A line for each row: a space before each word, one after the last, and a line feed.
    lengths = words.ends - words.starts
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    start = place[:-1] + 2 * words.row + 1
    buffer = np.full(int(place[-1]) + 2 * rows, 0x20, np.uint8)
    tx.put(buffer, start, lengths, words.data[words.inside])
    lines = place[words.bounds[1:]] + 2 * np.arange(1, rows + 1)
    buffer[lines - 1] = 0x0A
    buffer, lines = buffer.tobytes(), np.concatenate([[0], lines])
    row_of = lambda at: int(np.searchsorted(lines, at, "right")) - 1
    word_of = lambda at, row: int(np.searchsorted(start, at)) - int(words.bounds[row])
    base: dict[int, list] = {}
    for phrase, label in PHRASES.items():
        for at in places(buffer, f" {phrase} ".encode()):
            row = row_of(at)
            base.setdefault(row, []).append((word_of(at + 1, row), label))
    spans: dict[int, dict] = {}
    for notice in NOTICES:
        windows: dict[int, list] = {}
        for row, begin in zip(*(x.tolist() for x in candidates(notice, buffer, lines)), strict=True):
            windows.setdefault(row, []).append(begin)
        reach = 4 * notice.errors + 4
        for row, begins in windows.items():
            line, at = buffer[lines[row] : lines[row + 1] - 1], -1
            for begin in begins:
                # Every character put in before the place may be of four bytes; the window ends at word ends.
                begin -= int(lines[row])
                a = max(0, begin - reach)
                b = begin + len(notice.text) + len(notice.tail) + 2 * reach
                if begin + len(notice.text) <= at:  # within the last match
                    continue
                a = max(a, at)  # what follows a match begins at its end
                a, b = line.rfind(b" ", 0, a + 1), line.find(b" ", max(b, 0))
                a, b = max(a, 0), b if b >= 0 else len(line)
                window = line[a : b + 1].decode("utf-8", "replace")
                if not near(notice.text, notice.errors, window) or not (m := pattern(notice).search(window)):
                    continue
                first = lines[row] + a + len(window[: m.start()].encode())
                end = lines[row] + a + len(window[: m.end()].encode())
                errors = sum(m.fuzzy_counts)
                one = (notice.label, word_of(first, row), int(np.searchsorted(start, end)) - int(words.bounds[row]) - 1)
                score = 1 - errors / len(notice.text)
                if score > spans.setdefault(row, {}).get(one, (0, -1.0))[1]:
                    spans[row][one] = (errors, score)
                at = int(end - lines[row])
    out = []
    for row in range(rows):
        exact, fuzzy = base.get(row, []), spans.get(row, {})
        told = sorted({label for _, label in exact})
        out.append({
            "n_words": int(words.counts[row]), "n_base": len(exact), "first_word": min((w for w, _ in exact), default=None), "last_word": max((w for w, _ in exact), default=None),
            "base_labels": ",".join(told), "labels": ",".join(sorted({*told, *(label for label, _, _ in fuzzy)})),
            "score": 1.0 if exact else max((s for _, s in fuzzy.values()), default=0.0),
            "spans": [{"label": k[0], "first_word": k[1], "last_word": k[2], "errors": e, "score": s} for k, (e, s) in sorted(fuzzy.items())],
        })
    return out


def _search(batches):
    for part in tx.slices(batches):
        found = scan(part.column("text"))
        yield tx.batch_of(_FOUND, part.column("doc_id").cast(pa.int64()), *([r[n] for r in found] for n in _FOUND.names[1:]))


def search(docs: DataFrame) -> DataFrame:
    """Counts, labels, score and spans of all documents."""
    return docs.select("doc_id", "text").mapInArrow(_search, FOUND)


def op8_license_notices(spark, sf_dir):
    return search(tx.read_documents(spark, sf_dir)).drop("spans")

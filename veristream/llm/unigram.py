"""Token counts by count-only Viterbi.

The vocabulary's pieces, with their scores, are in an Aho-Corasick automaton, which enumerates all pieces that end at each
character.  For each place only the best score and the number of pieces on the best path are kept, never the
path.  Ties go as in the tokenizers library's Unigram model: among equal scores the piece that starts first wins; a
character that is no piece of its own is unknown at the lowest score less 10, unknown characters in a row are one
token, or one for each of their bytes where the vocabulary has bytes.  Spaces become U+2581, one is put
before the text, and pieces never reach over one (the library's Metaspace splitting), so a segment between spaces is counted
once for each task and looked up afterwards.  There is no shuffle.

The public files hold no unigram model, so the pieces and scores of ``piece_bpe_32k.model`` are used.

Defined results: a null or empty text has no tokens and score 0; rows repeated under one doc_id are counted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import textops as tx

VOCABULARY = "piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Fixed value: how far below the lowest score an unknown character lies.
UNKNOWN_PENALTY = 10.0
#: Bytes of distinct segments that a task remembers before it starts anew.
REMEMBERED = 8 << 20

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_segments", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[0x20] = True


def vocabulary(path: str) -> list[tuple[str, float]]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(n), model.get_score(n)) for n in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of segments."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.has_bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.known: dict[bytes, tuple[int, float]] = {}
        self.known_bytes = 0

    def count(self, segment: str) -> tuple[int, float]:
        """Tokens and score of the best path.  The automaton reports ends in order, and for each the longest piece, which
        starts first, first: a later one must be better."""
        if not self.single.issuperset(segment):
            return self._count_with_unknown(segment)
        score, tokens = [0.0] + [-np.inf] * len(segment), [0] * (len(segment) + 1)
        for end, (length, value) in self.automaton.iter(segment):
            start = end + 1 - length
            new = value + score[start]
            if new > score[end + 1]:
                score[end + 1], tokens[end + 1] = new, tokens[start] + 1
        return tokens[-1], score[-1]

    def _count_with_unknown(self, segment: str) -> tuple[int, float]:
        n = len(segment)
        score, tokens, unknown = [0.0] + [-np.inf] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(segment):
            ends[end].append(found)
        for at, found in enumerate(ends):
            end, char = at + 1, segment[at]
            for length, value in found:
                new = value + score[end - length]
                if new > score[end]:
                    score[end], tokens[end] = new, tokens[end - length] + 1
            # An unknown character starts last of all, so it must be better than every piece.
            if char not in self.single and self.unknown + score[at] > score[end]:
                score[end], unknown[end] = self.unknown + score[at], True
                tokens[end] = tokens[at] + (len(char.encode("utf-8", "surrogatepass")) if self.has_bytes else not unknown[at])
        return tokens[n], score[n]

    def remembered(self, segment: bytes) -> tuple[int, float]:
        if (found := self.known.get(segment)) is None:
            found = self.count(SPACE_MARK + segment.decode())
            self.known_bytes += len(segment)
            if self.known_bytes > REMEMBERED:
                self.known, self.known_bytes = {}, len(segment)
            self.known[segment] = found
        return found


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(vocabulary(path))


def count_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Characters, segments, tokens and scores of the texts of a slice."""
    data, offsets = tx.utf8(texts)
    rows = len(offsets) - 1
    segments = tx.Words(data, offsets, _ONLY_SPACE)
    # A mark within a text splits like a space; such texts are rare and are counted one by one.
    which, distinct = segments.codes()
    buffer, of = data.tobytes(), counter(path)
    mark = SPACE_MARK.encode()
    found = []
    for segment in distinct.to_pylist():
        parts = segment.split(mark)
        each = [of.remembered(p) for p in parts]
        found.append((sum(e[0] for e in each), sum(e[1] for e in each), len(parts)))
    n, score, parts = (np.array([f[k] for f in found], float) for k in range(3))
    total = lambda values: np.bincount(segments.row, values[which], rows) if len(found) else np.zeros(rows)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    spaces = np.concatenate([[0], np.cumsum(_ONLY_SPACE[data])])
    filled = offsets[1:] > offsets[:-1]
    # A text that begins with a space (or a mark) gets none put before it.
    begins = np.zeros(rows, bool)
    begins[filled] = _ONLY_SPACE[data[offsets[:-1][filled]]]
    every = spaces[offsets[1:]] - spaces[offsets[:-1]] + (filled & ~begins)
    empty = every - segments.counts
    one = of.remembered(b"")
    tokens, scores, n_segments = total(n) + empty * one[0], total(score) + empty * one[1], every + total(parts) - segments.counts
    if mark in buffer:
        for row in np.flatnonzero(filled):
            if buffer.startswith(mark, int(offsets[row])):
                tokens[row], scores[row], n_segments[row] = tokens[row] - one[0], scores[row] - one[1], n_segments[row] - 1
    return [points[offsets[1:]] - points[offsets[:-1]], n_segments.astype(np.int64), tokens.astype(np.int64), scores]


def _count(batches, path):
    for part in tx.slices(batches):
        yield tx.batch_of(_COUNTS, part.column("doc_id").cast(pa.int64()), *count_texts(part.column("text"), path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_chars, n_segments, n_tokens, score`` of all documents."""
    return docs.select("doc_id", "text").mapInArrow(partial(_count, path=path or public_tokenizers.path(VOCABULARY)), "doc_id long, n_chars long, n_segments long, n_tokens long, score double")


def op10_unigram_counts(spark, sf_dir):
    return token_counts(tx.read_documents(spark, sf_dir))

"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the code points cuts a text where the hash of the last ``WINDOW`` of them falls on a mark, so a
passage that two documents share falls into the same chunks in both.  A task encodes each distinct chunk once
and keeps it in a bounded dictionary.  A chunk's tokens are right in its inside, not at its ends, where a token or
the pattern that splits words may reach over the cut.  Joins are repaired: from the last *anchor* of the chunk before
to the first anchor of the chunk after, the text is encoded anew, and one anchor farther on either side, where the tokens must
agree exactly with the chunks' own; should they not, the repair widens to the whole text.  An anchor is a place where every
branch of the split pattern begins a new piece (:data:`_ANCHOR`).  A chunk with few anchors, as in text without spaces or
marks, isn't encoded by itself: it joins the stretch that is encoded anew, so no character of it is encoded
twice.  Special tokens' strings are cut out first, as the tokenizers library does.

The ranks come from the vocabulary file; the merge loop is tiktoken's, four times as fast here as that of tokenizers with
the same ids (tests compare them).  Decoding looks up the bytes of tokens.  There is no shuffle.

Defined results: a null text is an empty one (no tokens); repeated rows are encoded each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import textops as tx

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 16
#: The rolling hash marks one position in 2^CHUNK_BITS.
CHUNK_BITS = 9
LEAST, MOST = 64, 8192
#: Characters of distinct chunks that a task remembers before it starts anew.
REMEMBERED = 6 << 20

_BASE = 0x01000193
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_WHOLE = pa.schema([*_DIGEST, ("text", pa.string()), ("ids", pa.list_(pa.int32()))])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """A byte-level BPE vocabulary: encodes and decodes texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): n for token, n in told["model"]["vocab"].items() if token not in special}
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, n in [*ranks.items(), *((t.encode(), n) for t, n in special.items())]:
            self.bytes_of[n] = token
        self.digits_of = [str(n) for n in range(len(self.bytes_of))]
        self.length_of = np.array([len(b) for b in self.bytes_of])
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, tuple] = {}
        self.known_chars = 0
        #: What was asked for and what was done, in characters.
        self.encoded_chars = self.reused_chars = 0

    def chunk(self, text: str) -> tuple | None:
        """Tokens of a chunk, and its two first and two last anchors as (character, token); None for a chunk with fewer than
        three, whose tokens can't be checked against its neighbours'."""
        if (found := self.known.get(text)) is None:
            if (at := anchors(text)) is None:
                return None
            ids = self.plain(text)
            ends = np.cumsum(self.length_of[ids])
            marks = [(c, int(np.searchsorted(ends, len(text[:c].encode()))) + 1) for c in at]
            found = (ids, *marks)
            self.encoded_chars += len(text)
            self.known_chars += len(text)
            if self.known_chars > REMEMBERED:
                self.known, self.known_chars = {}, len(text)
            self.known[text] = found
        else:
            self.reused_chars += len(text)
        return found

    def _joined(self, before: tuple | None, between: list[str], after: tuple | None) -> list[int] | None:
        """The tokens from the last anchor of ``before`` (text and chunk; None: from the beginning) to the first of ``after`` (None:
        to the end), encoded anew.  The stretch goes one anchor farther on either side, and there its tokens must agree
        with the chunks' own."""
        parts, head, tail = [], [], []
        if before:
            text, (ids, _, _, inner, outer) = before
            head = ids[inner[1] : outer[1]]
            parts.append(text[inner[0] :])
        parts += between
        if after:
            text, (ids, outer, inner, _, _) = after
            tail = ids[outer[1] : inner[1]]
            parts.append(text[: inner[0]])
        found = self.plain("".join(parts))
        self.encoded_chars += sum(map(len, parts))
        end = len(found) - len(tail)
        return found[len(head) : end] if found[: len(head)] == head and found[end:] == tail else None

    def _stretch(self, text: str, out: list) -> None:
        """Append the tokens of a text without special tokens."""
        found, begin, between, before = [], 0, [], None
        for end in chunk_ends(text):
            piece = text[begin:end]
            begin = end
            chunk = self.chunk(piece) if len(piece) >= LEAST else None
            if chunk is None:
                between.append(piece)
                continue
            ids, first, _, _, last = chunk
            if before or between:
                repaired = self._joined(before, between, (piece, chunk))
                if repaired is None:
                    break
                found += repaired + ids[first[1] : last[1]]
            else:
                found += ids[: last[1]]
            before, between = (piece, chunk), []
        else:
            rest = self._joined(before, between, None) if between else before[1][0][before[1][4][1] :]
            if rest is not None:
                out += found + rest
                return
        # The chunks' tokens don't agree with what lies between them: the widest repair is the whole text.
        self.encoded_chars += len(text)
        out += self.plain(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._stretch(part, out)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: Where a new piece of the split pattern begins whatever else the text holds: at a single space between two characters that
#: aren't white space, and at these marks behind a letter.
_ANCHOR = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])|(?<=\p{L})(?=[.,;:!?\u3002\uff0c\u3001\uff1b\uff1a\uff1f\uff01])")


def anchors(text: str) -> tuple[int, int, int, int] | None:
    """The places of the two first and the two last anchors; None if there are fewer than three."""
    first = [m.start() for m, _ in zip(_ANCHOR.finditer(text), range(3), strict=False)]
    if len(first) < 3:
        return None
    last, width = first, 64
    while True:
        at = max(0, len(text) - width)
        last = [m.start() for m in _ANCHOR.finditer(text, at)]
        if len(last) >= 2 or not at:
            return first[0], first[1], last[-2], last[-1]
        width *= 4


def chunk_ends(text: str) -> list[int]:
    """Where the chunks of a text end: content decides, within LEAST and MOST characters."""
    n = len(text)
    if n < 2 * LEAST:
        return [n]
    h, width, base = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1), 1, _BASE
    while width < WINDOW:  # windows of twice the width, from two neighbours
        h = h[:-width] * np.uint32(base) + h[width:]
        width, base = 2 * width, base * base & 0xFFFFFFFF
    marks = np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHUNK_BITS) == 0) + WINDOW
    ends, at = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST and n - mark >= LEAST:
            at = mark
            ends.append(at)
    if at < n:
        ends.append(n)
    return ends


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def _texts(batches):
    for part in tx.slices(batches):
        yield part.column("doc_id").cast(pa.int64()), (t or "" for t in part.column("text").to_pylist())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of all documents."""

    def run(batches, path=path or public_tokenizers.path(VOCABULARY)):
        for ids, texts in _texts(batches):
            yield tx.batch_of(_IDS, ids, [codec(path).encode(t) for t in texts])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of token ids; null ids give an empty text."""

    def run(batches, path=path or public_tokenizers.path(VOCABULARY)):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([codec(path).decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digests(batches, path, whole):
    code = codec(path)
    for part in tx.slices(batches):
        n, of_ids, of_text, every = [], [], [], []
        for text in part.column("text").to_pylist():
            tokens = code.encode(text or "")
            n.append(len(tokens))
            of_ids.append(hashlib.sha256(",".join(map(code.digits_of.__getitem__, tokens)).encode()).hexdigest())
            of_text.append(hashlib.sha256(code.decode(tokens).encode()).hexdigest())
            if whole:
                every.append(np.array(tokens, np.int32))
        found = [part.column("doc_id").cast(pa.int64()), n, of_ids, of_text]
        yield tx.batch_of(_WHOLE, *found, part.column("text").cast(pa.string()), every) if whole else tx.batch_of(_DIGEST, *found)


def round_trip(docs: DataFrame, path: str | None = None, whole: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` and digests of the ids and of the text that they decode to, in one pass; ``text`` and ``ids`` too if
    ``whole``."""
    run = partial(_digests, path=path or public_tokenizers.path(VOCABULARY), whole=whole)
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", text string, ids array<int>" if whole else "")
    return docs.select("doc_id", "text").mapInArrow(run, columns)


def op1_bpe_round_trip(spark, sf_dir):
    return round_trip(tx.read_documents(spark, sf_dir))

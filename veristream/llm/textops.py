"""Vectorised helpers for UTF-8 text held in Arrow batches.

All functions work on one slice of an Arrow batch at a time, so a task's memory is bounded by the slice
(``SLICE_BYTES`` of text, or one document when a single document is larger).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

#: The white space that ends a word: the space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII lower-casing by table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

def read_documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls count as empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut Arrow batches into runs of rows of at most ``limit`` bytes of text, never less than one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        row, rows = 0, batch.num_rows
        while row < rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of a slice: byte positions, the row of each, and the range of words of each row.  Words end at the bytes of
    ``is_break``, or, where byte values don't tell, lie where ``inside`` is true."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_break: np.ndarray = SPACE, inside: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        self.inside = inside = ~is_break[data] if inside is None else inside
        # A word begins, or ends, where its row or a run of break bytes does.
        edge = np.empty(len(data) + 1, bool)
        edge[:-1], edge[-1:] = inside, False
        edge[1:-1] &= ~inside[:-1]
        rows = offsets[:-1][offsets[1:] > offsets[:-1]]
        edge[rows] = inside[rows]
        narrow = np.int32 if len(data) < 1 << 30 else np.int64
        self.starts = np.flatnonzero(edge[:-1]).astype(narrow)
        edge[1:], edge[0] = inside, False
        edge[1:-1] &= ~inside[1:]
        last = offsets[1:][offsets[1:] > offsets[:-1]]
        edge[last] = inside[last - 1]
        self.ends = np.flatnonzero(edge).astype(narrow)
        self.bounds = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=narrow), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def codes(self, data: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal bytes only, and the distinct words that the numbers stand for;
        ``data`` may be a lower-cased copy."""
        return span_codes((self.data if data is None else data)[self.inside], self.ends - self.starts)

    def digests(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of a 128-bit digest of each word, the same in every task."""
        codes, distinct = self.codes(data)
        halves = span_digests(distinct)
        return halves[codes, 0], halves[codes, 1]

    def row_end(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return self.bounds[self.row + 1]


def span_codes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of consecutive byte spans that together make up ``data``, by comparison of their bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def span_digests(spans: pa.Array) -> np.ndarray:
    """128-bit BLAKE2b digests of byte strings, as rows of two 64-bit numbers.  Nobody can choose strings that collide."""
    digest = hashlib.blake2b
    joined = b"".join([digest(s, digest_size=16).digest() for s in spans.to_pylist()])
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans from ``starts`` to ``ends``, for counts where words chosen to collide do no harm.

    Spans of up to 16 bytes, nearly all words, are read as two numbers; no two of one length up to 8 bytes collide.  Longer
    ones are hashed by XXH3."""
    length = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 9, np.uint64, padded, strides=(1,))
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    first = lanes[starts] & keep[np.minimum(length, 8)]
    second = lanes[np.minimum(starts + 8, len(data))] & keep[np.clip(length - 8, 0, 8)]
    hashes = _pair(_pair(length.astype(np.uint64), first), second)
    for i in np.flatnonzero(length > 16).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` items; windows that cross rows are for the caller to mask.

    Windows of powers of two are put together from two halves, each step finalised, so that no order of items
    cancels out as it would in a polynomial."""
    n = max(0, len(h) - width + 1)
    part, size, out, done = h, 1, None, 0
    while n:
        if width & size:
            at = part[done : done + n]
            out, done = (at.copy() if out is None else _pair(out, at)), done + size
        if done == width:
            return out
        part, size = _pair(part[: len(part) - size], part[size:]), 2 * size
    return np.zeros(0, np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges, one for each start and length."""
    total = int(lengths.sum())
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(at, lengths) + np.repeat(starts, lengths)


def put(buffer: np.ndarray, begin: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Write consecutive spans of ``data`` to their places in ``buffer``, some megabytes at a time."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = int(ends[at] - lengths[at])
        upto = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        buffer[ranges(begin[at:upto], lengths[at:upto])] = data[done : int(ends[upto - 1])]
        at = upto


def drawn(text: str, seed: int, blocks: int, block: int) -> str:
    """Of a text of over ``blocks * block`` characters, so many blocks of it at places drawn from its whole length; a shorter
    one as it is."""
    if len(text) <= blocks * block:
        return text
    places = np.random.default_rng(seed & 0xFFFFFFFF).integers(0, len(text) - block + 1, blocks)
    return " ".join(text[p : p + block] for p in sorted(places.tolist()))


def draw_blocks(batches, blocks: int, block: int):
    """Batches whose ``text`` is :func:`drawn` by their ``rank``."""
    for batch in batches:
        texts = [drawn(t, r, blocks, block) for t, r in zip(batch.column("text").to_pylist(), batch.column("rank").to_pylist(), strict=True)]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row the mask holds."""
    out, filled = np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(mask, offsets[:-1][filled], dtype=np.int64)
    return out


def batch_of(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)

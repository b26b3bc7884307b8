"""Exact substring deduplication by fixed-block anchors.

A passage of ``window`` words contains a whole block of ``window // 2`` words aligned in its own document, wherever it
starts.  So:

1. *Index and probe.*  Documents are dealt into groups of about ``GROUP_BYTES`` of text.  A group takes the hashes of
   all rolling blocks of its documents, each once, with two flags: found at an aligned position (indexed), found more
   than once.  They are dealt into buckets by hash as sorted, delta-coded, compressed arrays: two to three bytes a
   word.  A bucket reports to each group those of its hashes that are indexed somewhere and occur twice or more.
2. *Extend.*  In a group, every window that holds an anchor hit is a candidate.  Its 96-bit hash and its earliest place in
   the group (doc_id and start) go to a bucket; the bucket tells every group whose place is later than another's which windows start
   earlier elsewhere.
3. *Remove.*  Windows that start earlier elsewhere, or earlier in the group, are united to maximal repeats and cut.

Words are told apart by 128-bit BLAKE2b digests, windows by 64 finalised bits of either half (96 of them between groups).
The first step only filters (its 32-bit keys may let chance hits through, which the second step refutes).  A text
passes one shuffle, which all three steps share.  A passage found in many documents is one entry a group, so no
key is hot; no pair of documents is ever formed.

Defined results: a null text has no words; a null doc_id counts as larger than any other; rows repeated under one
doc_id at equal starts are not earlier than each other, so they don't remove each other, in whatever groups they lie; texts
shorter than a window stay; an empty table gives an empty result; other columns are carried unchanged.  Rows are dealt by their
place in the input, which must be read alike each time (a table, not a shuffle's rows in any order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .packed import Route, Rows, ddl, table_of, unpack_sorted

WINDOW = 20
GROUP_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20
#: Words are about this many bytes; only sizes of buckets depend on it.
WORD_BYTES = 6

_NO_ID = np.iinfo(np.int64).max
_MASK = np.uint64(0xFFFFFFFF)


class Group:
    """The words of a group's documents, ordered by doc_id.  Without ``texts`` only what their windows need is kept."""

    def __init__(self, table: pa.Table, texts: bool = True):
        self.docs = pa.concat_arrays(table.column("doc").chunks)
        ids = pc.fill_null(self.docs.field("doc_id").cast(pa.int64()), _NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.docs, self.ids = self.docs.take(pa.array(order)), ids[order]
        _, self.rank = np.unique(self.ids, return_inverse=True)
        self.parts, counts, digests = [], [], []
        for part in tx.slices([pa.record_batch([self.docs.field("text")], ["text"])]):
            words = tx.Words(*tx.utf8(part.column("text")))
            counts.append(words.counts)
            digests.append(words.digests())
            if texts:
                self.parts.append(words)
        if not texts:
            del self.docs
        join = lambda of, kind: np.concatenate(of) if of else np.zeros(0, kind)
        self.counts = join(counts, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.halves = [join([d[k] for d in digests], np.uint64) for k in range(2)]
        del digests
        self.size = len(self.halves[0])
        self.row = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        here = np.arange(self.size, dtype=np.int64)
        self.place = (here - np.repeat(self.bounds[:-1], self.counts)).astype(np.int32)
        self.left = (np.repeat(self.bounds[1:], self.counts) - here).astype(np.int32)

    def windows(self, width: int, halves: int = 1) -> list[np.ndarray]:
        """The first positions of all windows and their hashes, one array for each half of the words' digests."""
        at = np.flatnonzero(self.left >= width)
        return [at, *(tx.windows(half, width)[at] for half in self.halves[:halves])]

    def start(self, at: np.ndarray) -> np.ndarray:
        """Numbers of words in the order of doc_id and place; equal for equal places of one doc_id."""
        return (self.rank[self.row[at]].astype(np.int64) << 32) + self.place[at]

    def joined(self, keep: np.ndarray) -> pa.Array:
        """For each document its kept words, joined by one space."""
        out, word = [], 0
        for p in self.parts:
            kept = keep[word : word + len(p)]
            word += len(p)
            lengths = (p.ends - p.starts)[kept]
            n = np.bincount(p.row[kept], minlength=len(p.counts))
            size = lengths + 1
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
            buffer = np.full(int(size.sum()), 0x20, np.uint8)
            tx.put(buffer, begin, lengths, p.data[p.inside][np.repeat(kept, p.ends - p.starts)])
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            # The space after a row's last word goes.
            drop = np.zeros(len(buffer), bool)
            drop[(ends[1:] - 1)[n > 0]] = True
            offsets = ends - np.concatenate([[0], np.cumsum(n > 0)])
            out.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(buffer[~drop].tobytes())).cast(pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def spliced(self, keep: np.ndarray) -> pa.Array:
        """The texts without the words that aren't kept and the white space behind each; all else stays as it is."""
        out, word = [], 0
        for p in self.parts:
            gone = ~keep[word : word + len(p)]
            word += len(p)
            edge = np.zeros(len(p.data) + 1, np.int8)
            # A word's stretch goes on to the next word of its row, or to the row's end.
            ends = np.append(p.starts[1:], len(p.data)).astype(np.int64)
            last = p.bounds[1:][p.counts > 0] - 1
            ends[last] = p.offsets[1:][p.counts > 0]
            np.add.at(edge, p.starts[gone], 1)
            np.add.at(edge, ends[gone], -1)
            stay = np.cumsum(edge[:-1], dtype=np.int8) == 0
            offsets = np.concatenate([[0], np.cumsum(tx.row_sums(stay, p.offsets))]).astype(np.int64)
            out.append(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(p.data[stay]))).cast(pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())


class Steps:
    """The functions that run inside tasks."""

    def __init__(self, window: int, buckets: int, spliced: bool, fan: int | None = None):
        self.window, self.block, self.spliced = window, window // 2, spliced
        # A block's key is 32 bits long within its bucket.
        self.key_bits = min(64, 32 + buckets.bit_length())
        self.blocks = Route(buckets, [self.key_bits], [("flags", np.uint8, 1)], [], fan)
        self.windows = Route(buckets, [64], [("checks", np.uint32, 1), ("ids", np.int64, 1), ("places", np.int32, 1)], [], fan)

    def _key(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.key_bits)

    def probe(self, key, table):
        group = Group(table, texts=False)
        at, h = group.windows(self.block)
        k = self._key(h)
        order = np.argsort(k)
        k, aligned = k[order], (group.place[at] % self.block == 0)[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        if not len(first):
            return table_of(self.blocks.there, [])
        flags = np.logical_or.reduceat(aligned, first).astype(np.uint8) | (np.diff(first, append=len(k)) > 1).astype(np.uint8) << 1
        return table_of(self.blocks.there, self.blocks.sent(key[0].as_py(), 0, k[first], [flags]))

    def hits(self, key, table):
        rows = Rows(table, self.blocks.payload)
        (flags,) = rows.values[0]
        order = np.argsort(rows.keys, kind="stable")
        ranked = rows.keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        indexed = np.logical_or.reduceat((flags & 1)[order] > 0, first)
        found = np.add.reduceat(1 + (flags[order] >> 1).astype(np.int64), first)
        hit = np.empty(len(ranked), bool)
        hit[order] = np.repeat(indexed & (found > 1), np.diff(first, append=len(ranked)))
        return table_of(self.blocks.back, self.blocks.answers(key[0].as_py(), table, rows, [], hit))

    def candidates(self, key, left, right):
        group = Group(left, texts=False)
        at, h = group.windows(self.block)
        rows = sorted(zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist(), strict=True))
        if not rows:
            return table_of(self.windows.there, [])
        known = np.concatenate([unpack_sorted(b, np.uint64) for _, b in rows])
        hit = np.zeros(group.size + 1, np.int32)
        k = self._key(h)
        hit[1:][at[known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k]] = 1
        hit = np.cumsum(hit, dtype=np.int32)
        at, h, check = group.windows(self.window, 2)
        some = hit[at + self.window - self.block + 1] > hit[at]
        at, h, check = at[some], h[some], (check[some] & _MASK).astype(np.uint32)
        order = np.lexsort((group.start(at), check, h))
        at, h, check = at[order], h[order], check[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        at, h, check = at[first], h[first], check[first]
        return table_of(self.windows.there, self.windows.sent(key[0].as_py(), 0, h, [check, group.ids[group.row[at]], group.place[at]]))

    def lost(self, key, table):
        rows = Rows(table, self.windows.payload)
        (check,), (ids,), (places,) = rows.values
        order = np.lexsort((places, ids, check, rows.keys))
        ranked, check, ids, places = rows.keys[order], check[order], ids[order], places[order]
        first = np.ones(len(order), bool)
        first[1:] = (ranked[1:] != ranked[:-1]) | (check[1:] != check[:-1])
        # The first of each run is the earliest; equal places are not later.
        least = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        later = np.zeros(len(order), bool)
        later[order] = (ids > ids[least]) | (places > places[least])
        return table_of(self.windows.back, self.windows.answers(key[0].as_py(), table, rows, [], later))

    def removed(self, group: Group, right) -> np.ndarray:
        """Which words of the group lie in a window that starts earlier."""
        at, h = group.windows(self.window)
        gone = np.zeros(group.size, bool)
        if not len(at):
            return gone
        lost = [unpack_sorted(b, np.uint64) for b in right.column("keys").to_pylist()]
        lost = np.sort(np.concatenate(lost)) if lost else np.zeros(0, np.uint64)
        later = lost[np.minimum(np.searchsorted(lost, h), len(lost) - 1)] == h if len(lost) else np.zeros(len(h), bool)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        del h
        start = group.start(at[order])
        later[order] |= start > np.repeat(np.minimum.reduceat(start, first), np.diff(first, append=len(start)))
        edge = np.zeros(len(gone) + 1, np.int32)
        cut = at[later]
        del order, start
        np.add.at(edge, cut, 1)
        np.add.at(edge, cut + self.window, -1)
        return np.cumsum(edge[:-1], dtype=np.int32) > 0

    def cut(self, key, left, right):
        group = Group(left)
        gone = self.removed(group, right)
        del group.halves
        rows = len(group.counts)
        begins = gone & ((group.place == 0) | ~np.concatenate([[False], gone[:-1]])[: len(gone)])
        ends = gone & ((group.left == 1) | ~np.concatenate([gone[1:], [False]])[: len(gone)])
        at = np.concatenate([[0], np.cumsum(np.bincount(group.row[begins], minlength=rows))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (group.place[begins], group.place[ends] + 1)]
        return pa.table({"doc": group.docs, "n_words": group.counts.astype(np.int64), "n_removed": np.bincount(group.row[gone], minlength=rows).astype(np.int64), "kept": group.spliced(~gone) if self.spliced else group.joined(~gone), "removed_from": lists[0], "removed_to": lists[1]})


def deduplicate(
    docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, bucket_keys: int = BUCKET_KEYS, spliced: bool = False, fan: int | None = None
) -> DataFrame:
    """For each document: ``doc`` (its row), ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space; or, if
    ``spliced``, the text with the repeats cut out and all else as it was) and ``removed_from``, ``removed_to``: the maximal
    repeats that were cut, as ranges of words."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    steps = Steps(window, 1 + total // (WORD_BYTES * bucket_keys), spliced, fan)
    n = 1 + total // group_bytes
    # Results don't depend on what lies where, so no text or id that many rows share makes a hot group.
    g = F.pmod(F.monotonically_increasing_id(), F.lit(n))
    dealt = docs.select(g.cast("long").alias("g"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    by_group = dealt.groupBy("g")
    blocks, windows = steps.blocks, steps.windows
    probes = by_group.applyInArrow(lambda k, t: steps.probe(k, t), ddl(blocks.there))
    hits = blocks.returned(blocks.dealt(probes, n).applyInArrow(lambda k, t: steps.hits(k, t), ddl(blocks.back)))
    candidates = by_group.cogroup(hits.groupBy("g")).applyInArrow(lambda k, a, b: steps.candidates(k, a, b), ddl(windows.there))
    lost = windows.returned(windows.dealt(candidates, n).applyInArrow(lambda k, t: steps.lost(k, t), ddl(windows.back)))
    numbers = T.ArrayType(T.IntegerType())
    out = T.StructType().add("doc", dealt.schema["doc"].dataType).add("n_words", "long").add("n_removed", "long")
    out = out.add("kept", "string").add("removed_from", numbers).add("removed_to", numbers)
    return by_group.cogroup(lost.groupBy("g")).applyInArrow(lambda k, a, b: steps.cut(k, a, b), out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeats cut out of ``text`` (and ``n_chars``, where there is one, brought up to date);
    what is left keeps its lines and spaces, and a null text stays null."""
    found = deduplicate(docs, spliced=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))
    return found.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op3_substring_dedup(spark, sf_dir):
    found = deduplicate(tx.read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
g AS (SELECT r, doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN md5(list_aggregate(ws[i:i + 19], 'string_agg', ' ')) END AS g FROM p),
f AS (SELECT r, i, word, g IS NOT NULL AND row(coalesce(doc_id, 9223372036854775807), i) > min(row(coalesce(doc_id, 9223372036854775807), i)) OVER (PARTITION BY g) AS later FROM g),
c AS (SELECT r, i, word, max(later::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT r, sum(gone)::bigint AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '') AS kept FROM c GROUP BY r)
SELECT d.doc_id, len(d.ws)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

"""SimHash near-duplicate groups, searched with pivot distance tables.

Equal fingerprints are one node from the start, so copies cost nothing.  Nodes meet in buckets of equal keys: two fingerprints of 64
bits that differ in at most three agree in at least three of six bit blocks, so the 20 choices of three blocks are keys that lose no
link; they are some 32 bits long, which spreads random fingerprints over 2^32 buckets for each choice.

Within a bucket, rows come sorted by the distance to the first of ``N_PIVOTS`` reference fingerprints; the distance
table to all of them is computed once per row, a pair is discarded when any coordinate differs by more than the radius
(triangle inequality, so no link is lost), and survivors are verified by their Hamming distance.  Rows that are joined
already needn't be compared: first every row meets ``LEADERS`` rows of its bucket, then what the bucket's largest
component doesn't hold meets all rows.  A family of near-copies costs about one comparison a row and leader.  A bucket
returns a spanning forest of its links, never all pairs.

Defined results: a null or wordless text has fingerprint zero and links like any other; rows repeated under one doc_id
share a component; a null doc_id takes part but is never the id of a component unless no member has one; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import checkpointed, components, spread_join

SEED = 42
N_PIVOTS = 16
LEADERS = 8
#: Pairs compared, and shingles hashed, at once, to bound memory.
PAIRS, SHINGLES = 1 << 20, 1 << 18
#: (lowest bit, number of bits) of six blocks; two fingerprints within three bits agree in three of them.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: The bits of each byte as the bytes of one number: up to ``MOST`` of these add up without a carry from one to the next.
BITS, MOST = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0], 255


class Space(NamedTuple):
    """What is fingerprinted, in how many 64-bit lanes, and how many differing bits link."""

    shingle: int
    lanes: int
    radius: int

    @property
    def columns(self) -> list[str]:
        return [f"fp{k}" for k in range(self.lanes)]

    @property
    def pivots(self) -> np.ndarray:
        return np.random.default_rng(20240229).integers(0, 2**64, (N_PIVOTS, self.lanes), dtype=np.uint64)


EXACT = Space(shingle=3, lanes=1, radius=3)


def shingle_hashes(buffer: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of the hash of each span: XXH64."""
    digest, spans = xxhash.xxh64_intdigest, zip(begin.tolist(), end.tolist(), strict=True)
    return np.fromiter((digest(buffer[a:b], SEED) for a, b in spans), "<u8", len(begin)).view(np.uint8).reshape(-1, 8)


class Spans(NamedTuple):
    """Shingles of a slice's texts as byte spans of ``buffer``: rows that have words, and where each one's shingles end."""

    buffer: bytes
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    rows: np.ndarray
    n: np.ndarray
    until: np.ndarray
    size: int

    def row(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.until, number, "right")

    def words(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last word of the shingles of these numbers."""
        row = self.row(number)
        first = self.bounds[self.rows[row]] + number - (self.until - self.n)[row]
        return first, np.minimum(first + self.size, self.bounds[self.rows[row] + 1]) - 1

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shingles of these numbers begin and end."""
        first, last = self.words(number)
        return self.begin[first], self.end[last]


def shingle_spans(texts: pa.Array, size: int) -> Spans | None:
    """The shingles of lower-cased words, joined by spaces; None where no text has a word."""
    data, offsets = tx.utf8(texts)
    words = tx.Words(data, offsets)
    if not len(words):
        return None
    lengths = words.ends - words.starts
    end = np.cumsum(lengths + 1, dtype=np.int64) - 1
    begin = end - lengths
    joined = np.full(int(end[-1]) + 1, 0x20, np.uint8)
    tx.put(joined, begin, lengths, tx.LOWER[data[words.inside]])
    rows = np.flatnonzero(words.counts)
    n = np.maximum(words.counts[rows] - size + 1, 1)
    return Spans(joined.tobytes(), begin, end, words.bounds, rows, n, np.cumsum(n), size)


def window_hashes(spans: Spans, number: np.ndarray, lanes: int) -> np.ndarray:
    """Bytes of the hash of the shingles of consecutive numbers, made of their words' hashes: 64 bits, mixed anew for each lane."""
    first, last = spans.words(number)
    begin, end = (at[first[0] : last[-1] + 1] for at in (spans.begin, spans.end))
    data = np.frombuffer(spans.buffer, np.uint8)[begin[0] : end[-1]]
    words, length, h = tx.word_hashes(data, begin - begin[0], end - begin[0]), last - first + 1, np.empty(len(number), np.uint64)
    for width in np.unique(length).tolist():
        some = length == width
        h[some] = tx.windows(words, width)[first[some] - first[0]]
    return tx.mix(h[:, None] ^ tx.mix(np.arange(1, lanes + 1, dtype=np.uint64))).view(np.uint8)


def simhashes(texts: pa.Array, space: Space = EXACT) -> np.ndarray:
    """Fingerprints of the texts of one slice, a row of lanes each."""
    out = np.zeros((len(texts), space.lanes), np.uint64)
    spans = shingle_spans(texts, space.shingle)
    if spans is None:
        return out
    total = int(spans.until[-1])
    ones = np.zeros((len(spans.rows), 64 * space.lanes), np.int64)
    for at in range(0, total, SHINGLES):
        number = np.arange(at, min(at + SHINGLES, total))
        row = spans.row(number)
        h = shingle_hashes(spans.buffer, *spans.of(number)) if space.lanes == 1 else window_hashes(spans, number, space.lanes)
        fresh = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        runs = -(-np.diff(fresh, append=len(row)) // MOST)
        part = np.repeat(fresh, runs) + MOST * tx.ranges(np.zeros_like(runs), runs)
        of_row = np.cumsum(runs) - runs
        for k, column in enumerate(np.ascontiguousarray(h.T)):
            bits = np.add.reduceat(BITS[column], part).view(np.uint8).reshape(-1, 8)
            ones[row[fresh], 8 * k : 8 * k + 8] += np.add.reduceat(bits, of_row, axis=0, dtype=np.int64)
    out[spans.rows] = np.packbits(2 * ones > spans.n[:, None], axis=1, bitorder="little").view("<u8")
    return out


def fingerprints(docs: DataFrame, space: Space = EXACT) -> DataFrame:
    """``doc_id, text_hash`` and the fingerprint's lanes of all documents."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", *space.columns)])

    def run(batches):
        for part in tx.slices(batches):
            found = simhashes(part.column("text"), space).view(np.int64)
            lanes = (np.ascontiguousarray(found[:, k]) for k in range(space.lanes))
            yield tx.batch_of(schema, part.column("doc_id").cast(pa.int64()), part.column("text_hash"), *lanes)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, _longs(schema.names))


def _longs(names) -> str:
    return ", ".join(f"{n} long" for n in names)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of n nodes by the pairs a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _verified(fp, table, i, j, radius):
    """Of the pairs i, j those within the radius: by pivot coordinates first, then by the distance itself."""
    for p in range(table.shape[1]):
        near = np.abs(table[i, p] - table[j, p]) <= radius
        i, j = i[near], j[near]
    near = distances(fp[i], fp[j]) <= radius
    return i[near], j[near]


def bucket_links(key: np.ndarray, fp: np.ndarray, space: Space = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by key and then by the first pivot's distance."""
    n, radius = len(fp), space.radius
    here = np.arange(n)
    table = np.stack([distances(fp, pivot) for pivot in space.pivots], axis=1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(first, append=n)
    bucket = np.repeat(np.arange(len(first)), size)
    left, right = [], []
    for k in range(LEADERS):
        lead = (first + k * size // LEADERS)[bucket]
        near = (distances(fp, fp[lead]) <= radius) & (lead != here)
        left.append(lead[near])
        right.append(here[near])
    root = forest(n, np.concatenate(left), np.concatenate(right))
    # What the largest component of a bucket doesn't hold meets every row that the first coordinate leaves.
    members = np.bincount(root, minlength=n)[root]
    largest = np.minimum.reduceat(np.where(members == np.maximum.reduceat(members, first)[bucket], root, n), first)
    todo = np.flatnonzero(root != largest[bucket])
    place = bucket * 1024 + table[:, 0]
    low, high = np.searchsorted(place, place[todo] - radius), np.searchsorted(place, place[todo] + radius, "right")
    left, right, held = [here], [root], 0
    while len(todo):
        lengths = np.minimum(high - low, max(1, PAIRS // len(todo)))
        for at in range(0, len(todo), PAIRS):
            i, j = np.repeat(todo[at : at + PAIRS], lengths[at : at + PAIRS]), tx.ranges(low[at : at + PAIRS], lengths[at : at + PAIRS])
            apart = root[i] != root[j]
            i, j = _verified(fp, table, i[apart], j[apart], radius)
            left.append(i)
            right.append(j)
            held += len(i)
        if held > n:
            root = forest(n, np.concatenate(left), np.concatenate(right))
            left, right, held = [here], [root], 0
        low = low + lengths
        more = low < high
        todo, low, high = todo[more], low[more], high[more]
    root = forest(n, np.concatenate(left), np.concatenate(right))
    joined = np.flatnonzero(root != here)
    return joined, root[joined]


def _partition_links(batches, space):
    """The links of a partition's buckets, which come one after the other; a bucket is put together once."""
    schema = pa.schema([(f"{side}{k}", pa.int64()) for side in "ab" for k in range(space.lanes)])

    def links(parts):
        key, fp = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        i, j = bucket_links(key, fp, space)
        return tx.batch_of(schema, *(np.ascontiguousarray(fp[side, k]).view(np.int64) for side in (i, j) for k in range(space.lanes)))

    held: list = []
    for batch in batches:
        key = batch.column("key").to_numpy()
        if not len(key):
            continue
        fp = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in space.columns], axis=1)
        cut = int(np.searchsorted(key, key[-1])) if not (held and key[-1] == held[-1][0][-1]) else 0
        if cut or (held and key[0] != held[-1][0][-1]):
            done = [*held, (key[:cut], fp[:cut])]
            held = []
            if sum(len(p[0]) for p in done):
                yield links(done)
        held.append((key[cut:], fp[cut:]))
    if held:
        yield links(held)


def _block_keys(space: Space) -> Column:
    keys = []
    for number, chosen in enumerate(combinations(BLOCKS, 3)):
        key = F.lit(number).cast("long")
        for low, size in chosen:
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(F.col("fp0"), low).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
        keys.append(key)
    return F.array(*keys)


def links(nodes: DataFrame, space: Space = EXACT) -> DataFrame:
    """Spanning links ``a, b`` of pairs of distinct fingerprints within the radius; ``a`` and ``b`` are :func:`node` values."""
    dealt = nodes.select(F.explode(_block_keys(space)).alias("key"), *space.columns)
    pivot = space.pivots[:1].view(np.int64)[0]
    first = sum(F.bit_count(F.col(c).bitwiseXOR(F.lit(int(p)))) for c, p in zip(space.columns, pivot, strict=True))
    sides = [f"{side}{k}" for side in "ab" for k in range(space.lanes)]
    found = dealt.repartition("key").sortWithinPartitions("key", first).mapInArrow(partial(_partition_links, space=space), _longs(sides))
    return found.select(*(node(sides[k : k + space.lanes]).alias(s) for s, k in (("a", 0), ("b", space.lanes))))


def node(lanes: list[str]) -> Column:
    """A fingerprint as one value."""
    return F.col(lanes[0]) if len(lanes) == 1 else F.struct(*(F.col(c).alias(f"fp{k}") for k, c in enumerate(lanes)))


def rooted(prints: DataFrame, space: Space) -> DataFrame:
    """``fp, least, root``: each fingerprint, the smallest row that has it (doc_id and hash of the text, nulls last) and its
    component's root."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = checkpointed(prints.groupBy(*space.columns).agg(F.min(row).alias("least")))
    roots = components(links(nodes.select(*space.columns), space)).select(F.col("node").alias("fp"), "root")
    return nodes.select(node(space.columns).alias("fp"), "least").join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, space: Space = EXACT) -> DataFrame:
    """``doc_id``, the fingerprint's lanes and ``component_id`` of all documents."""
    prints = checkpointed(fingerprints(docs, space).select("doc_id", "text_hash", *space.columns))
    found = checkpointed(rooted(prints, space))
    ids = found.groupBy("root").agg(F.min("least").getField("doc_id").alias("component_id"))
    # A root's nodes, and a fingerprint's documents, may be a third of all.
    ids = spread_join(found, ids, ["root"]).select("fp", "component_id")
    return spread_join(prints.withColumn("fp", node(space.columns)), ids, ["fp"]).select("doc_id", *space.columns, "component_id")


def op9_simhash_groups(spark, sf_dir):
    found = groups(tx.read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")

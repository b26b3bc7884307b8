"""Near-duplicate texts: SimHash candidates, each verified by the similarity of its texts' shingle sets.

Every distinct text is a node with a fingerprint of 256 bits over its 5-word shingles.  Texts of a similarity of 0.8 differ in
39 bits on average and in ``RADIUS`` or fewer 996 times in a thousand.  Nodes meet in buckets of equal keys; a key is a sample of bits,
as many as leave some ``OCCUPANCY`` nodes in a bucket, and there are as many keys as bring a pair that differs in ``TYPICAL`` bits
together with probability ``RECALL`` (closer pairs more surely).

In a bucket a pair is discarded when some of its lanes differ by more than the radius, as nearly all do.  The distances to ``LEADERS`` of the
bucket's rows are a pivot table: a pair is discarded when a coordinate differs by more than the radius (triangle inequality, so no
link is lost), and survivors are verified by their Hamming distance.  Pivots are taken from the bucket as random ones are 128 bits from everything and discard nothing at this radius.  In a bucket of over ``SMALL`` rows, those within
``TIGHT`` bits of a leader meet only the leaders and the rows that no leader is near.  A bucket first returns a minimum spanning forest of
its links, the closest first.

Links are candidates only.  First each node's closest link is verified on the texts; then the others, but for those between
nodes that what was found joins within a few steps.  A forest that verification thins out no longer joins all that is alike, so the nodes
with candidates meet in their buckets once more.  First a bucket only names its nodes that have a link within the radius to another group.
These meet again with a profile of their shingles, how many fall into each of ``CLASSES`` classes: two texts share at most the sum of the
smaller counts, so a pair whose similarity that bounds below 0.8 needs no verification and is none.  Of the other links a bucket
gives a minimum spanning forest of its groups; when these are verified and the groups are joined, all links that are
left between different groups are verified too.  What is left is the links whose texts share 0.8 or more of their shingles.

Defined results: texts without words are alike; one of fewer than five words is one shingle; a null text has no words.
Rows repeated under one doc_id are judged one by one.  :func:`near_dedup` keeps one row of each group, the smallest by
(doc_id, hash of the text), nulls last, and of equal rows one; an empty table gives an empty result; other columns are carried
unchanged, whatever their names.  A pair of very long texts is compared in one task, which holds 64-bit hashes of their shingles.
"""

from __future__ import annotations

from functools import partial
from math import ceil, log, log2, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import checkpointed, components, spread_join, stored
from .simhash import SEED, Space, distances, fingerprints, forest, shingle_spans

SPACE = Space(shingle=5, lanes=4, radius=54)
SIMILARITY = 0.8
#: Differing bits of the pairs that keys are made to find, and how surely.
TYPICAL, RECALL = 46, 0.99
#: Rows in a bucket: comparing so many costs about as much as dealing out the keys that they spare.
OCCUPANCY = 256
LEADERS = 8
SMALL, TIGHT = 64, 24
#: Pairs compared at once, to bound memory; by their fingerprints; by their profiles; of rows that lie side by side.
PAIRS, PRINTS, PROFILES, BLOCK = 1 << 20, 1 << 15, 1 << 11, 1 << 14
#: Bytes of buckets' rows that are compared in one go, but for a bucket that is larger.
HELD = 4 << 20
#: Classes of shingles in a text's profile, a byte each.
CLASSES = 256
PROFILE = ["size", "unit", *(f"p{k}" for k in range(CLASSES // 8))]


def samples(n: int) -> np.ndarray:
    """Bits of each key for n nodes."""
    width = 64 * SPACE.lanes
    bits = min(64, max(4, ceil(log2(max(n, 2) / OCCUPANCY))))
    # Bits of a key are drawn without putting back: the chance that none of them differs.
    agree = prod((width - TYPICAL - k) / (width - k) for k in range(bits))
    keys = ceil(log(1 - RECALL) / log(1 - agree))
    draw = np.random.default_rng(20240301)
    return np.array([draw.choice(width, bits, replace=False) for _ in range(keys)])


def _dealt(batches, chosen, columns):
    schema = pa.schema([(c, pa.int64()) for c in columns])
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            fp = np.stack([part.column(c).to_numpy() for c in SPACE.columns], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
            for number, sample in enumerate(chosen):
                wide = np.zeros((len(fp), 64 * -(-len(sample) // 64)), np.uint8)
                wide[:, : len(sample)] = bits[:, sample]
                # Spread out before the bits go in: small numbers would only swap the buckets of one sample with those of another.
                key = tx.mix(np.full(len(fp), number + 1, np.uint64))
                for word in np.packbits(wide, axis=1, bitorder="little").view("<u8").T:
                    key = tx.mix(key ^ word)
                yield tx.batch_of(schema, key.view(np.int64), *(part.column(c) for c in schema.names[1:]))


def spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the links i, j of lengths d make a minimum spanning forest of n nodes, by Boruvka's rounds."""
    order = np.argsort(d, kind="stable")
    root, kept = np.arange(n), []
    while True:
        a, b = root[i[order]], root[j[order]]
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        if not len(order):
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        place, least = np.arange(len(order)), np.full(n, len(order))
        np.minimum.at(least, a, place)
        np.minimum.at(least, b, place)
        best = np.unique(least[least < len(order)])
        kept.append(order[best])
        root = forest(n, a[best], b[best])[root]


def between(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows, some at a time: only numbers of rows are held for all."""
    out = np.empty(len(i), np.int16)
    for at in range(0, len(i), PRINTS):
        some = slice(at, at + PRINTS)
        out[some] = distances(fp[i[some]], fp[j[some]])
    return out


def lanes_of(fp: np.ndarray) -> np.ndarray:
    """The fingerprints' lanes, each in one piece."""
    return np.ascontiguousarray(fp.T)


def apart(lanes: np.ndarray, i, j) -> np.ndarray:
    """How many bits of these lanes rows i and j differ in."""
    out = np.bitwise_count(lanes[0][i] ^ lanes[0][j])
    if 64 * len(lanes) > 255:
        out = out.astype(np.int16)
    for lane in lanes[1:]:
        out += np.bitwise_count(lane[i] ^ lane[j])
    return out


def near_pairs(lanes: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows those within the radius, and their distances: by half of the bits, by the pivot table, by all; some at a time."""
    kept, half = [(i[:0], j[:0], np.zeros(0, np.int16))], lanes[: len(lanes) // 2]
    for at in range(0, len(i), PRINTS):
        a, b = i[at : at + PRINTS], j[at : at + PRINTS]
        near = np.flatnonzero(apart(half, a, b) <= SPACE.radius)
        if not len(near):
            continue
        a, b = a[near], b[near]
        near = (np.abs(table[a] - table[b]) <= SPACE.radius).all(axis=1)
        a, b = a[near], b[near]
        d = apart(lanes, a, b)
        near = d <= SPACE.radius
        kept.append((a[near], b[near], d[near]))
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def bucket_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links of rows sorted by key, and the links' lengths.  Rows that two different leaders hold don't
    meet here, but in :func:`bucket_links`."""
    n, here, lanes = len(fp), np.arange(len(fp)), lanes_of(fp)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(first, append=n)
    bucket = np.repeat(np.arange(len(first)), size)
    leaders = np.stack([first + k * size // LEADERS for k in range(LEADERS)])
    table = np.stack([apart(lanes, slice(None), lead[bucket]) for lead in leaders], axis=1)
    leads = np.zeros(n, bool)
    leads[leaders] = True
    nearest = table.argmin(axis=1)
    held = ~leads & (size[bucket] > SMALL) & (table[here, nearest] <= TIGHT)
    found, links = [(here[held], leaders[nearest, bucket][held], table[here, nearest][held])], int(held.sum())
    for i, j in _meetings(lanes, bucket, np.flatnonzero(~held), np.flatnonzero(held)):
        near = near_pairs(lanes, table, i, j)
        if not len(near[0]):
            continue
        found.append(near)
        links += len(near[0])
        if links > max(4 * n, PAIRS):
            found = [_least(n, found)]
            links = len(found[0][0])
    return _least(n, found)


def _meetings(lanes: np.ndarray, bucket: np.ndarray, free: np.ndarray, held: np.ndarray):
    """Pairs of rows of a bucket that may be within the radius, some at a time: each free row with all free ones after it, by all lanes but
    the last, and with all that are held."""
    own, of, found, some = lanes[:-1, free], bucket[free], [], 0
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    for at, end in zip(first.tolist(), np.append(first[1:], len(of)).tolist(), strict=True):
        while at < end - 1:
            to = min(end, at + max(1, BLOCK // (end - at)))
            i, j = np.divmod(np.flatnonzero(apart(own, np.s_[at:to, None], np.s_[None, at:end]) <= SPACE.radius), end - at)
            once = i < j
            if once.any():
                found.append((free[at + i[once]], free[at + j[once]]))
                some += len(found[-1][0])
            if some > PRINTS:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
                found, some = [], 0
            at = to
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
    at, end = (np.searchsorted(bucket[held], of, side) for side in ("left", "right"))
    todo = np.flatnonzero(at < end)
    for i, j in _ranges_met(todo, at[todo], end[todo]):
        yield free[i], held[j]


def _ranges_met(todo: np.ndarray, at: np.ndarray, end: np.ndarray):
    """Pairs of each row of ``todo`` and what lies from ``at`` to ``end``, some at a time."""
    while len(todo):
        step = np.minimum(end - at, max(1, PAIRS // len(todo)))
        for part in range(0, len(todo), PAIRS):
            some = slice(part, part + PAIRS)
            yield np.repeat(todo[some], step[some]), tx.ranges(at[some], step[some])
        at = at + step
        more = at < end
        todo, at, end = todo[more], at[more], end[more]


def bucket_links(key: np.ndarray, fp: np.ndarray, label: np.ndarray):
    """All links within the radius of rows sorted by key and label, between rows of one key and different labels; some at a time."""
    n, lanes = len(fp), lanes_of(fp)
    starts = lambda *columns: np.flatnonzero(np.concatenate([[True], *[np.any([c[1:] != c[:-1] for c in columns], axis=0)]]))
    ends = lambda first: np.repeat(np.append(first[1:], n), np.diff(first, append=n))
    first = starts(key)
    size = np.diff(first, append=n)
    bucket = np.repeat(np.arange(len(first)), size)
    table = np.stack([apart(lanes, slice(None), (first + k * size // LEADERS)[bucket]) for k in range(LEADERS)], axis=1)
    # A row meets what comes after its own label in its bucket.
    at, end = ends(starts(key, *label.T)), ends(first)
    todo = np.flatnonzero(at < end)
    for i, j in _ranges_met(todo, at[todo], end[todo]):
        i, j, _ = near_pairs(lanes, table, i, j)
        if len(i):
            yield i, j


def profile(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """How many of the hashes fall into each class, in units that let a byte hold the most; rounded up."""
    counts = np.bincount((shingles & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    unit = max(1, -(-int(counts.max()) // 255))
    return unit, (-(-counts // unit)).astype(np.uint8)


def may_be_alike(i: np.ndarray, j: np.ndarray, size: np.ndarray, unit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs of rows can reach the similarity, by their profiles: true for all that do."""
    out = np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j])
    todo = np.flatnonzero(out)
    for at in range(0, len(todo), PROFILES):
        some = todo[at : at + PROFILES]
        a, b = i[some], j[some]
        both = np.minimum(counts[a] * unit[a, None], counts[b] * unit[b, None]).sum(axis=1)
        both = np.minimum(both, np.minimum(size[a], size[b]))
        every = size[a] + size[b] - both
        out[some] = (every == 0) | (both / np.maximum(every, 1) >= SIMILARITY)
    return out


def _least(n, found):
    i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
    kept = spanning(n, i, j, d)
    return i[kept], j[kept], d[kept]


def _buckets(batches):
    """Whole buckets, several at a time, from batches that come sorted by key: arrays of the columns."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        size += rows.nbytes
        if size >= HELD and held[0][0, 0] != rows[-1, 0]:
            rows = np.concatenate(held)
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield rows[:cut]
            held = [rows[cut:].copy()]
            size = held[0].nbytes
    if held:
        yield np.concatenate(held)


def _candidates(batches):
    schema = pa.schema([(c, pa.int64()) for c in ("a_fp", "a_hash", "b_fp", "b_hash", "d")])
    for rows in _buckets(batches):
        i, j, d = bucket_pairs(rows[:, 0], np.ascontiguousarray(rows[:, 1:-1]).view(np.uint64))
        yield tx.batch_of(schema, rows[i, 1], rows[i, -1], rows[j, 1], rows[j, -1], d.astype(np.int64))


def _by_label(rows):
    """Buckets' rows sorted by key and group; keys, fingerprints and groups."""
    lanes = SPACE.lanes
    rows = rows[np.lexsort((rows[:, lanes + 3], rows[:, lanes + 2], rows[:, 0]))]
    return rows, rows[:, 0], np.ascontiguousarray(rows[:, 1 : 1 + lanes]).view(np.uint64), rows[:, lanes + 2 : lanes + 4]


def _crossing(batches):
    schema = pa.schema([("fp", pa.int64()), ("hash", pa.int64())])
    for rows in _buckets(batches):
        rows, key, fp, label = _by_label(rows)
        crosses = np.zeros(len(rows), bool)
        for i, j in bucket_links(key, fp, label):
            crosses[i] = crosses[j] = True
        yield tx.batch_of(schema, rows[crosses, 1], rows[crosses, 1 + SPACE.lanes])


def joining(group: np.ndarray, fp: np.ndarray, links) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of links i, j between rows of different groups (numbers from 0) those of a minimum spanning forest of the groups."""
    n, found, held = int(group.max()) + 1, [], 0

    def least():
        i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = spanning(n, group[i], group[j], d)
        return [(i[kept], j[kept], d[kept])]

    for i, j in links:
        found.append((i, j, between(fp, i, j)))
        held += len(i)
        if held > max(4 * n, PAIRS):
            found = least()
            held = len(found[0][0])
    return [(i, j) for i, j, _ in (least() if found else [])]


def _links(batches, forest_only):
    schema = pa.schema([(c, pa.int64()) for c in ("a_fp", "a_hash", "b_fp", "b_hash")])
    lanes = SPACE.lanes
    for rows in _buckets(batches):
        rows, key, fp, label = _by_label(rows)
        size, unit = rows[:, lanes + 4], rows[:, lanes + 5]
        counts = np.ascontiguousarray(rows[:, lanes + 6 :]).view(np.uint8)
        links = ((i[near], j[near]) for i, j in bucket_links(key, fp, label) if (near := may_be_alike(i, j, size, unit, counts)).any())
        if forest_only:
            group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (label[1:] != label[:-1]).any(axis=1)]))
            links = joining(group, fp, links)
        for i, j in links:
            yield tx.batch_of(schema, rows[i, 1], rows[i, 1 + lanes], rows[j, 1], rows[j, 1 + lanes])


def _node(fp: str, text_hash: str) -> Column:
    """A text is known by its hash and a quarter of its fingerprint, which is made of other hashes."""
    return F.struct(F.col(fp).alias("fp"), F.col(text_hash).alias("hash"))


def _pair() -> list[Column]:
    a, b = _node("a_fp", "a_hash"), _node("b_fp", "b_hash")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _in_buckets(nodes: DataFrame, columns: list[str], chosen: np.ndarray) -> DataFrame:
    """``key`` and the columns of all nodes, once for each key, whole buckets together."""
    columns = ["key", *columns]
    dealt = nodes.select(*columns[1:]).mapInArrow(partial(_dealt, chosen=chosen, columns=columns), ", ".join(f"{c} long" for c in columns))
    return dealt.repartition("key").sortWithinPartitions("key")


def candidates(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``a, b, d``: distinct pairs of nodes, a < b, that a bucket's forest holds."""
    dealt = _in_buckets(nodes, [*SPACE.columns, "text_hash"], chosen)
    found = dealt.mapInArrow(_candidates, "a_fp long, a_hash long, b_fp long, b_hash long, d long")
    return found.select(*_pair(), "d").distinct()


ROOT = ["root_fp", "root_hash"]


def _with_root(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.select(*SPACE.columns, "text_hash", F.col("root.fp").alias("root_fp"), F.col("root.hash").alias("root_hash"), *columns)


def crossing(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``node``: those that meet a node of another ``root`` in a bucket within the radius."""
    named = _with_root(nodes)
    return _in_buckets(named, named.columns, chosen).mapInArrow(_crossing, "fp long, hash long").distinct().select(F.struct("fp", "hash").alias("node"))


def missed(nodes: DataFrame, chosen: np.ndarray, forest_only: bool) -> DataFrame:
    """``a, b``: distinct pairs of nodes, a < b, that meet in a bucket within the radius, whose ``root`` differs and whose profiles let
    them be alike: all, or those of a minimum spanning forest of each bucket's groups."""
    named = _with_root(nodes, *PROFILE)
    found = _in_buckets(named, named.columns, chosen).mapInArrow(partial(_links, forest_only=forest_only), "a_fp long, a_hash long, b_fp long, b_hash long")
    return found.select(*_pair()).distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    spans = shingle_spans(texts, SPACE.shingle)
    out = [np.zeros(0, np.uint64)] * len(texts)
    if spans is None:
        return out
    at = 0
    digest, buffer = xxhash.xxh3_64_intdigest, spans.buffer
    for row, until in zip(spans.rows.tolist(), spans.until.tolist(), strict=True):
        begin, end = spans.of(np.arange(at, until))
        hashes = (digest(buffer[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist(), strict=True))
        out[row] = np.unique(np.fromiter(hashes, np.uint64, until - at))
        at = until
    return out


def _profiles(batches):
    node = pa.struct([("fp", pa.int64()), ("hash", pa.int64())])
    schema = pa.schema([("node", node), *((c, pa.int64()) for c in PROFILE)])
    for part in tx.slices(batches):
        sets = shingle_sets(part.column("text"))
        unit, counts = zip(*map(profile, sets), strict=True)
        size = np.array([len(s) for s in sets], np.int64)
        yield tx.batch_of(schema, part.column("node").cast(node), size, np.array(unit, np.int64), *np.stack(counts).view(np.int64).T)


def _alike(batches):
    node = pa.struct([("fp", pa.int64()), ("hash", pa.int64())])
    schema = pa.schema([("a", node), ("b", node)])
    for part in tx.slices(batches, "a_text"):
        pairs = zip(shingle_sets(part.column("a_text")), shingle_sets(part.column("b_text")), strict=True)
        alike = pa.array([similarity(a, b) >= SIMILARITY for a, b in pairs], pa.bool_())
        yield tx.batch_of(schema, *(part.column(c).filter(alike).cast(node) for c in "ab"))


def alike(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The links ``a, b`` whose ``texts`` (``node, text``) share enough of their shingles."""
    for side in "ab":
        links = links.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")), side)
    node = "struct<fp: bigint, hash: bigint>"
    return links.select("a", "b", "a_text", "b_text").mapInArrow(_alike, f"a {node}, b {node}")


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components ``node, root`` after more links ``a, b``: those of the groups that the links join, which are far fewer than the nodes."""
    edges = found
    for side in "ab":
        of = roots.select(F.col("node").alias(side), F.col("root").alias("_root"))
        edges = edges.join(of, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    tops = stored(components(stored(edges)))
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    moved = moved.select("node", F.coalesce("_top", "root").alias("root"))
    return moved.union(tops.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def near_labels(found: DataFrame) -> DataFrame:
    """``node, label``: the smallest node within two links.  Nodes of one label are connected."""
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("label"))
    beside = spread_join(both, one.withColumnRenamed("a", "b"), ["b"], F.col("a"))
    return beside.groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "node")


def _named(column: Column) -> tuple[Column, Column]:
    """A key without nulls: rows of one doc_id and text fall together for a join and for a number alike."""
    return F.coalesce(column, F.lit(0)), column.isNull()


def _keyed(least: str) -> list[Column]:
    id_, unnamed = _named(F.col(f"{least}.doc_id"))
    return [id_.alias("_id"), unnamed.alias("_unnamed"), F.col(f"{least}.text_hash").alias("_hash")]


KEY = ["_id", "_unnamed", "_hash"]


def rooted(docs: DataFrame) -> DataFrame:
    """``node, least, root``: each distinct text, the smallest row that has it (doc_id, nulls last) and its group's root."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    prints = fingerprints(docs, SPACE)
    nodes = checkpointed(prints.groupBy(*SPACE.columns, "text_hash").agg(F.min(row).alias("least")).withColumn("node", _node("fp0", "text_hash")))
    chosen = samples(nodes.count())
    links = checkpointed(candidates(nodes, chosen))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    linked = both.select(F.col("a").alias("node")).distinct().join(nodes.select("node", "least"), "node").select("node", *_keyed("least"))
    id_, unnamed = _named(docs["doc_id"].cast("long"))
    rows = docs.select(id_.alias("_id"), unnamed.alias("_unnamed"), F.xxhash64(docs["text"]).alias("_hash"), docs["text"].alias("text"))
    texts = stored(rows.join(linked, KEY).dropDuplicates(["node"]).select("node", F.coalesce("text", F.lit("")).alias("text")))
    closest = both.groupBy("a").agg(F.min(F.struct("d", "b")).getField("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    closest = checkpointed(closest)
    found = checkpointed(alike(closest, texts))
    labels = checkpointed(near_labels(found))
    rest = links.select("a", "b").join(closest, ["a", "b"], "left_anti")
    for side, other in ("ab", "ba"):
        label = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        rest = spread_join(rest, label, [side], F.col(other), "left")
    rest = rest.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    found = checkpointed(found.union(alike(rest, texts)))
    # Tables from here on: a checkpoint keeps what the planner inferred of its rows, which doubles from one to the next.
    roots = stored(components(stored(found)))
    grouped = both.select(F.col("a").alias("node")).distinct().join(nodes.select("node", *SPACE.columns, "text_hash"), "node")
    regrouped = lambda rows: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    profiles = texts.join(crossing(regrouped(grouped), chosen), "node").select("node", "text")
    profiles = profiles.mapInArrow(_profiles, "node struct<fp: bigint, hash: bigint>, " + ", ".join(f"{c} long" for c in PROFILE))
    grouped = stored(grouped.join(profiles, "node"))
    asked = links.select("a", "b")
    for forest_only in (True, False):
        more = stored(missed(regrouped(grouped), chosen, forest_only).join(asked, ["a", "b"], "left_anti"))
        found = stored(alike(more, texts))
        if found.head(1):
            roots = stored(joined(roots, found))
        asked = asked.union(more)
    return nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near-duplicates."""
    first = rooted(docs).groupBy("root").agg(F.min("least").alias("least")).select(*_keyed("least"))
    id_, unnamed = _named(docs["doc_id"].cast("long"))
    every = F.struct(*(docs[c] for c in docs.columns))
    rows = docs.select(every.alias("_doc"), id_.alias("_id"), unnamed.alias("_unnamed"), F.xxhash64(docs["text"]).alias("_hash"), F.xxhash64(every).alias("_order"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("_order"))
    kept = rows.join(first, KEY).withColumn("_n", number).where("_n = 1")
    return kept.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))

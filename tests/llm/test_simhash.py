import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from veristream.llm import simhash
from veristream.llm.cluster import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return [" ".join(words[k : k + size]).encode() for k in range(max(1, len(words) - size + 1))] if words else []


def print_of(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(prints, radius=3):
    """For each fingerprint the smallest one reachable, by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def check(rows, texts):
    """rows: (doc_id, fingerprint, component_id) of texts in any order."""
    by_text = sorted((d if d is not None else -1, f"{print_of(t):016x}") for d, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint) for r in rows) == by_text
    root = classes(int(f, 16) for _, f in by_text)
    least = {}
    for d, f in by_text:
        if d >= 0:
            key = root[int(f, 16)]
            least[key] = min(d, least.get(key, d))
    for r in rows:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])


def test_groups(spark, docs, odd, empty, sf_dir, as_table):
    check(simhash.op9_simhash_groups(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check(simhash.op9_simhash_groups(spark, as_table(odd)).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.groups(empty).count() == 0


def test_links_lose_nothing(spark):
    draw = random.Random(9)
    flip = lambda p, n: p ^ sum(1 << b for b in draw.sample(range(64), n))
    centres = [draw.getrandbits(64) for _ in range(40)]
    prints = {flip(c, draw.randint(0, 4)) for c in centres for _ in range(25)}
    chain = [draw.getrandbits(64)]
    for _ in range(60):
        chain.append(flip(chain[-1], 3))
    prints |= {*chain, *(draw.getrandbits(64) for _ in range(500))}
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp0 long")
    got = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    want = classes(prints)
    signed = lambda p: int(np.uint64(p).astype(np.int64))
    groups = Counter(want.values())
    assert len(got) == sum(n for n in groups.values() if n > 1)
    mine = {}
    for p in prints:
        mine.setdefault(got.get(signed(p), signed(p)), set()).add(want[p])
    assert all(len(s) == 1 for s in mine.values()) and len(mine) == len(groups)


def test_a_large_bucket_gives_a_forest():
    draw = np.random.default_rng(1)
    base = np.uint64(draw.integers(0, 2**63))
    flips = lambda n: np.uint64(sum(1 << int(b) for b in draw.choice(32, n, replace=False)))
    fp = np.unique(np.array([base ^ flips(draw.integers(0, 3)) for _ in range(300)] + [base ^ flips(draw.integers(8, 14)) for _ in range(900)], np.uint64))
    other = np.unique(draw.integers(0, 2**63, 500).astype(np.uint64))
    fp, key = np.concatenate([fp, other]), np.repeat([7, 9], [len(fp), len(other)])
    order = np.lexsort((np.bitwise_count(fp ^ simhash.EXACT.pivots[0, 0]), key))
    i, j = simhash.bucket_links(key[order], fp[order, None])
    assert len(i) < len(fp)
    root, want = simhash.forest(len(fp), i, j), classes(fp.tolist())
    pairs = {(int(r), want[int(f)]) for r, f in zip(root, fp[order], strict=True)}
    assert len(pairs) == len({r for r, _ in pairs}) == len({w for _, w in pairs})


def test_buckets_across_batches_are_put_together():
    draw = np.random.default_rng(3)
    fp = np.unique(draw.integers(0, 2**63, 40) & ~np.int64(7))
    fp = np.sort(np.concatenate([fp, fp | 1, fp | 3])).astype(np.int64)
    key = np.repeat(np.arange(4), len(fp))
    fp = np.tile(fp, 4)
    order = np.lexsort((np.bitwise_count(fp.view(np.uint64) ^ simhash.EXACT.pivots[0, 0]), key))
    table = pa.table({"key": key[order], "fp0": fp[order]})
    whole = {(a, b) for t in simhash._partition_links(table.to_batches(), simhash.EXACT) for a, b in zip(*t.to_pydict().values(), strict=True)}
    for size in (1, 7, 100, 130):
        parts = {(a, b) for t in simhash._partition_links(table.to_batches(size), simhash.EXACT) for a, b in zip(*t.to_pydict().values(), strict=True)}
        assert parts == whole and len(whole) > 60


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(100)] + [(7, 7), (2000, 3000)] + [(5000, 5000 + k) for k in range(1, 300)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}

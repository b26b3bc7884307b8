"""The pipeline's near-duplicates against all pairs of shingle sets."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_simhash import shingles
from veristream.llm import similar, simhash


def groups_by_hand(rows):
    """Rows (doc_id, text) by group, comparing the shingle sets of all pairs of distinct texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = [set(shingles(t, 5)) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            every = len(sets[a]) + len(sets[b]) - both
            if not every or both / every >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    place, groups = {t: k for k, t in enumerate(texts)}, {}
    for d, t in rows:
        groups.setdefault(find(place[t or ""]), []).append((d, t))
    return list(groups.values())


def check_kept(kept, rows):
    groups = groups_by_hand(rows)
    assert len(kept) == len(groups)
    for group in groups:
        mine = [r for r in kept if r in group]
        assert len(mine) == 1
        named = [d for d, _ in group if d is not None]
        assert mine[0][0] == (min(named) if named else None)


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows.collect()]


def test_one_row_of_each_group_stays(docs, odd, empty):
    for table in (odd, docs):
        kept = similar.near_dedup(table)
        assert kept.columns == table.columns
        check_kept(pairs(kept), pairs(table))
    assert similar.near_dedup(empty).count() == 0


def test_works_by_row(spark):
    draw = random.Random(11)
    text = lambda: " ".join(draw.choices([f"w{k}" for k in range(500)], k=80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, text()), (None, None), (None, "")]
    got = pairs(similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (2, b), (3, c), rows[6], next(r for r in got if not r[1])]))


def edited(draw, text, words, edits):
    other = list(text)
    for k in range(edits):
        other[(k * len(text)) // edits + 5] = draw.choice(words)
    return other


def test_recall_in_each_band_and_nothing_below(spark):
    """Of pairs from 0.8 up at least 0.95 are found in each band (0.8 to 0.85, to 0.9, above), of pairs below none."""
    draw = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    rows, found = [], {}
    for k in range(900):
        text = draw.choices(words, k=400)
        other = edited(draw, text, words, draw.randint(1, 17))
        a, b = (set(shingles(" ".join(t), 5)) for t in (text, other))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
        found[2 * k + 1] = len(a & b) / len(a | b)
    kept = {d for d, _ in pairs(similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {2 * k for k in range(900)} <= kept
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.1)):
        band = [d for d, s in found.items() if low <= s < high]
        assert len(band) > 50 and sum(d not in kept for d in band) / len(band) >= 0.95
    below = [d for d, s in found.items() if s < 0.8]
    assert len(below) > 200 and kept.issuperset(below)


def test_a_family_whose_members_are_not_all_alike(spark):
    """Chains and families: 300 edited copies of one text, some like only some others, come out as by hand."""
    draw = random.Random(13)
    words = [f"w{k}" for k in range(3000)]
    text = draw.choices(words, k=200)
    rows, last = [], text
    for k in range(150):
        rows.append((k, " ".join(edited(draw, text, words, draw.randint(1, 6)))))
        last = edited(draw, last, words, 2)
        rows.append((1000 + k, " ".join(last)))
    check_kept(pairs(similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


def test_equal_fingerprints_of_unlike_texts_are_not_joined(spark):
    """A shingle that is most of a text makes its fingerprint; the sets still differ."""
    rows = [(1, "ha " * 200), (2, "ha " * 200 + " ".join(f"w{k}" for k in range(9)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({tuple(r) for r in simhash.fingerprints(table, similar.SPACE).select(*similar.SPACE.columns).collect()}) == 1
    assert sorted(pairs(similar.near_dedup(table))) == rows


def prints(draw, n, near, bits):
    """n fingerprints, of which the first ``near`` differ from one in some of ``bits`` bits."""
    fp = draw.integers(0, 2**63, (n, 4)).astype(np.uint64)
    base = np.unpackbits(fp[0].view(np.uint8))
    for k in range(1, near):
        flip = draw.choice(256, draw.integers(0, bits), replace=False)
        other = base.copy()
        other[flip] ^= 1
        fp[k] = np.packbits(other).view(np.uint64)
    return fp


def test_a_bucket_gives_a_minimum_spanning_forest():
    """Real links within the radius, as many as join what all pairs join; in a small bucket they are the shortest."""
    draw = np.random.default_rng(4)
    for n, near, bits in ((40, 25, 45), (60, 60, 60), (700, 400, 45), (1, 1, 2)):
        fp = prints(draw, n, near, bits)
        i, j, d = similar.bucket_pairs(np.zeros(n, np.int64), fp)
        assert (d == simhash.distances(fp[i], fp[j])).all() and (d <= similar.SPACE.radius).all()
        a, b = np.triu_indices(n, 1)
        far = simhash.distances(fp[a], fp[b])
        a, b, far = (c[far <= similar.SPACE.radius] for c in (a, b, far))
        root = simhash.forest(n, a, b)
        assert (simhash.forest(n, i, j) == root).all() and len(i) == n - len(np.unique(root))
        if n <= similar.SMALL:
            # A minimum spanning forest by plain Kruskal has the same total length.
            total, roots = 0, list(range(n))
            for k in np.argsort(far, kind="stable"):
                x, y = roots[a[k]], roots[b[k]]
                if x != y:
                    total += int(far[k])
                    roots = [x if r == y else r for r in roots]
            assert total == d.sum()


def test_buckets_across_batches_are_put_together():
    draw = np.random.default_rng(5)
    key = np.repeat(np.arange(6), [1, 40, 3, 25, 1, 60])
    fp = np.concatenate([prints(draw, n, n, 40) for n in (1, 40, 3, 25, 1, 60)]).view(np.int64)
    table = pa.table({"key": key, **{f"fp{k}": fp[:, k] for k in range(4)}, "text_hash": np.arange(len(key))})
    links = lambda size: sorted(tuple(r.values()) for t in similar._candidates(table.to_batches(size)) for r in t.to_pylist())
    whole = links(None)
    assert len(whole) > 100 and all(links(size) == whole for size in (1, 7, 41, 130))


def test_keys_find_typical_pairs():
    """Of pairs that differ in TYPICAL bits a share of RECALL agrees in a key, at sizes from few to very many nodes."""
    draw = np.random.default_rng(6)
    for n in (10, 10_000, 10_000_000):
        chosen = similar.samples(n)
        differs = np.array([np.isin(np.arange(256), draw.choice(256, similar.TYPICAL, replace=False)) for _ in range(2000)])
        met = np.zeros(2000, bool)
        for bits in chosen:
            met |= ~differs[:, bits].any(axis=1)
        assert met.mean() > similar.RECALL - 0.02


def test_many_links_of_one_text(spark):
    """A text with many edited copies is the hub of their links; nothing is lost and all texts are read whole."""
    draw = random.Random(14)
    words = [f"w{k}" for k in range(3000)]
    text = draw.choices(words, k=300)
    rows = [(k, " ".join(edited(draw, text, words, 1))) for k in range(500)] + [(900, " ".join(text))]
    kept = similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")))
    assert [r.doc_id for r in kept.collect()] == [0]


def families(draw, n, members):
    """Texts in families of which some members are alike and some are just not."""
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(n):
        text = draw.choices(words, k=150)
        for m in range(members):
            other = list(text)
            for at in draw.sample(range(8), draw.randint(1, 3)):
                other[5 + 18 * at] = draw.choice(words)
            rows.append((k * members + m, " ".join(other)))
    return rows


def test_no_link_is_lost_where_a_forest_holds_links_of_unlike_texts(spark, monkeypatch):
    """All nodes in one bucket, so that only what a bucket leaves out can be missing."""
    monkeypatch.setattr(similar, "samples", lambda n: np.zeros((1, 0), np.int64))
    rows = families(random.Random(15), 60, 12)
    check_kept(pairs(similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


def test_all_links_between_different_labels():
    draw = np.random.default_rng(7)
    key, label = np.repeat(np.arange(5), [1, 60, 3, 200, 40]), np.zeros((304, 2), np.int64)
    fp = np.concatenate([prints(draw, n, n, 40) for n in (1, 60, 3, 200, 40)])
    label[:, 1] = draw.integers(0, 6, len(key))
    order = np.lexsort((label[:, 1], key))
    label = label[order]
    i, j = (np.concatenate(c) for c in zip(*similar.bucket_links(key, fp, label), strict=True))
    a, b = np.triu_indices(len(key), 1)
    want = (key[a] == key[b]) & (label[a] != label[b]).any(axis=1) & (simhash.distances(fp[a], fp[b]) <= similar.SPACE.radius)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(a[want].tolist(), b[want].tolist(), strict=True))


def test_profiles_lose_no_pair_that_is_alike():
    """Sizes from none to more than a byte counts in a class; of near pairs that are not alike most are told."""
    draw = np.random.default_rng(8)
    sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for size, members in ((1, 3), (7, 20), (150, 60), (900, 40), (200_000, 3)):
        base = draw.integers(0, 2**63, size, dtype=np.uint64)
        for share in np.linspace(0, 0.25, members):
            changed = draw.random(size) < share
            sets.append(np.unique(np.where(changed, draw.integers(0, 2**63, size, dtype=np.uint64), base)))
    unit, counts = (np.array(c) for c in zip(*map(similar.profile, sets), strict=True))
    size = np.array([len(s) for s in sets])
    assert unit.max() > 1
    i, j = np.triu_indices(len(sets), 1)
    may = similar.may_be_alike(i, j, size, unit, counts)
    alike = np.array([similar.similarity(sets[a], sets[b]) >= similar.SIMILARITY for a, b in zip(i, j, strict=True)])
    assert alike.sum() > 300 and may[alike].all()
    middle = (size[i] > 100) & (size[i] < 200) & (size[j] > 100) & (size[j] < 200) & ~alike
    assert middle.sum() > 300 and may[middle].mean() < 0.5


def test_a_large_family_that_is_not_alike_is_not_verified_pair_by_pair(spark, monkeypatch):
    """300 texts within the radius of each other but not alike, and two halves of 200 that are: pairs verified grow with the texts."""
    monkeypatch.setattr(similar, "samples", lambda n: np.zeros((1, 0), np.int64))
    asked, before = [], similar.alike

    def alike(links, texts):
        asked.append(links.count())
        return before(links, texts)

    monkeypatch.setattr(similar, "alike", alike)
    draw = random.Random(16)
    words = [f"w{k}" for k in range(3000)]
    text, rows = draw.choices(words, k=200), []
    for k in range(300):
        other = list(text)
        for at in draw.sample(range(25), 5):
            other[8 * at + 3] = draw.choice(words)
        rows.append((k, " ".join(other)))
    for k in range(200):
        other = list(text[::-1])
        other[3 + 15 * (k % 12)] = draw.choice(words)
        other[8 + 180 * (k % 2)] = draw.choice(words)
        rows.append((1000 + k, " ".join(other)))
    check_kept(pairs(similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))), rows)
    assert sum(asked) < 10 * len(rows)


def test_memory_of_a_bucket():
    """Pairs of a family are millions: what is held for all that are compared at once is their numbers, not their fingerprints or profiles."""
    n, draw = 1200, np.random.default_rng(1)
    fp = np.tile(draw.integers(0, 2**64, similar.SPACE.lanes, dtype=np.uint64), (n, 1))
    fp[np.arange(n), draw.integers(0, similar.SPACE.lanes, n)] ^= np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)
    label = np.stack([np.arange(n)] * 2, axis=1)
    size, unit, counts = np.full(n, 256), np.ones(n, np.int64), np.ones((n, similar.CLASSES), np.uint8)
    tracemalloc.start()
    links = sum(int(similar.may_be_alike(i, j, size, unit, counts).sum()) for i, j in similar.bucket_links(np.zeros(n, np.int64), fp, label))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == n * (n - 1) // 2
    assert peak < 64 << 20, f"{peak >> 20} MB"


def test_buckets_of_different_keys_stay_apart():
    """A bucket holds rows of one sample of bits: none twice, and as many as the sample leaves, however many keys there are."""
    draw = np.random.default_rng(9)
    n = 20_000
    fp = draw.integers(-(2**63), 2**63, (n, 4))
    table = pa.table({**{f"fp{k}": fp[:, k] for k in range(4)}, "text_hash": np.arange(n)})
    chosen = similar.samples(n)
    rows = pa.Table.from_batches(list(similar._dealt(table.to_batches(), chosen, ["key", *table.column_names])))
    key, size = np.unique(rows["key"].to_numpy(), return_counts=True)
    assert len(rows) == n * len(chosen) and len(chosen) > 4
    assert len(np.unique(np.stack([rows["key"].to_numpy(), rows["text_hash"].to_numpy()]), axis=1).T) == len(rows)
    assert len(key) > 0.9 * len(chosen) * 2 ** chosen.shape[1] and size.mean() < 2 * n / 2 ** chosen.shape[1]


def test_buckets_compared_together_or_apart(monkeypatch):
    """However many rows are compared in one go, and however large a batch or a bucket is, the links are the same."""
    draw = np.random.default_rng(10)
    sizes = [1, 40, 3, 300, 1, 60, 2]
    key = np.repeat(np.arange(len(sizes)), sizes)
    fp = np.concatenate([prints(draw, n, n, 40) for n in sizes]).view(np.int64)
    table = pa.table({"key": key, **{f"fp{k}": fp[:, k] for k in range(4)}, "text_hash": np.arange(len(key))})
    links = lambda size: sorted(tuple(r.values()) for t in similar._candidates(table.to_batches(size)) for r in t.to_pylist())
    whole = links(None)
    assert len(whole) == len(key) - len(sizes)
    for held, block in ((0, 1), (100, 64), (5_000, 1 << 14), (1 << 22, 7)):
        monkeypatch.setattr(similar, "HELD", held)
        monkeypatch.setattr(similar, "BLOCK", block)
        assert all(links(size) == whole for size in (1, 7, 130, None))


def test_pairs_that_differ_by_a_fifth_meet_in_far_more_than_they_are_made_to():
    """Of pairs that differ in TYPICAL bits 0.97 and more meet, by keys that grow slowly: rows in buckets are what a corpus pays for."""
    draw = np.random.default_rng(11)
    for n in (200_000, 3_000_000):
        chosen = similar.samples(n)
        differs = np.array([np.isin(np.arange(256), draw.choice(256, similar.TYPICAL, replace=False)) for _ in range(4000)])
        assert np.any([~differs[:, bits].any(axis=1) for bits in chosen], axis=0).mean() > 0.97
        assert len(chosen) < 100 and n / 2 ** chosen.shape[1] < 512


def test_fingerprints_of_many_shingles(monkeypatch):
    """More shingles than a byte counts and than are hashed at once: a text's fingerprint is that of the majority, alone or among others."""
    draw = random.Random(17)
    texts = ["", None, "a", "B c", *(" ".join(draw.choices(["x", "Yy", "a word of over 16 letters".replace(" ", "_"), "é"], k=draw.randint(1, 900))) for _ in range(40))]
    alone = np.concatenate([simhash.simhashes(pa.array([t], pa.string()), similar.SPACE) for t in texts])
    for size in (1, 7, 300, 1 << 18):
        monkeypatch.setattr(simhash, "SHINGLES", size)
        assert (simhash.simhashes(pa.array(texts), similar.SPACE) == alone).all()
    spans = simhash.shingle_spans(pa.array(texts), similar.SPACE.shingle)
    bits = np.unpackbits(simhash.window_hashes(spans, np.arange(spans.until[-1]), 4), axis=1, bitorder="little")
    of = spans.row(np.arange(spans.until[-1]))
    for number, row in enumerate(spans.rows.tolist()):
        want = np.packbits(bits[of == number].mean(axis=0) > 0.5, bitorder="little").view("<u8")
        assert (alone[row] == want).all()
    words = lambda t: simhash.simhashes(pa.array([t]), similar.SPACE)[0]
    assert (words("A b  c\td e") == words("a b c d E")).all() and (words("a b c d e") != words("a b c d f")).any() and (words("a") != words("b")).any()

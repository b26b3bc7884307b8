import math
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from veristream.llm import compression, textops


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in compression.op7_compression_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == docs.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [d for d in quality if rows[d].held_out]
    right = np.mean([rows[d].predicted == quality[d] for d in held])
    assert right >= 0.9 > np.mean([quality[d] for d in held])


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(compression.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = compression.train(docs, labels), compression.train(docs, turned)
    assert (a.good, a.bad, a.weights.tolist()) == (b.good, b.bad, b.weights.tolist())


def by_hand(model, text):
    """The score of a text from the two dictionaries and the weights, one block after the other."""
    raw, sizes = (text or "").encode(), []
    for data in (model.good, model.bad):
        of = zstandard.ZstdCompressionDict(data)
        whole = 0
        for at in range(0, len(raw), 512):
            whole += len(zstandard.ZstdCompressor(level=3, dict_data=of, write_content_size=False, write_dict_id=False).compress(raw[at : at + 512]))
        sizes.append(whole)
    good, bad = sizes
    x = [1.0, (bad - good) / (bad + good), (bad + good) / 2 / len(raw)] if raw else [1.0, 0.0, 0.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_scores_by_brute_force(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = compression.train(docs, labels)
    rows = {r.doc_id: r.score for r in compression.classify(docs, model).collect()}
    for r in docs.collect():
        assert rows[r.doc_id] == pytest.approx(by_hand(model, r.text))


def sample_by_hand(rows, quality, size):
    """The texts that either dictionary learns from: the first by hash of all different labelled ones."""
    h = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed)
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    ranked = {0: [], 1: []}
    for d, text in set(rows):
        if d in quality and zlib.crc32(str(d).encode()) % 5:
            own = h(text.encode(), 42)
            rank = signed(h(own.to_bytes(8, "little"), h(d.to_bytes(8, "little"), 42)))
            ranked[quality[d]].append((rank, d, textops.drawn(text, rank, compression.PARTS, compression.PART)))
    return {q: [t for _, _, t in sorted(some)[: 2 * size]][::2] for q, some in ranked.items()}


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    """Long texts are drawn as short ones are, in blocks; repeated rows neither widen the sample nor move the shares."""
    monkeypatch.setattr(compression, "SAMPLE", 20)
    draw = random.Random(3)
    words = {0: [f"bad{k}" for k in range(50)], 1: [f"good{k}" for k in range(50)]}
    rows, labels = [], []
    for d in range(200):
        q = int(d % 5 > 0)
        text = " ".join(draw.choices(words[q], k=60))
        rows += [(d, text)] * (3 if d % 7 == 0 else 1) + ([(d, " ".join(draw.choices(words[q], k=6000)))] if d % 3 == 0 else [])
        labels.append((d, q))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(compression, "dictionary", lambda texts: seen.append(texts) or b"".join(t.encode() for t in texts))
    model = compression.train(df, known)
    want = sample_by_hand(rows, dict(labels), 20)
    assert seen == [want[1], want[0]] and [len(t) for t in seen] == [20, 20]
    assert max(map(len, seen[0])) == compression.PARTS * (compression.PART + 1) - 1
    scores = [(r.score, r.predicted, int(r.doc_id % 5 > 0)) for r in compression.classify(df.dropDuplicates(), model).collect()]
    assert np.mean([p == q for _, p, q in scores]) > 0.85 > np.mean([q for _, _, q in scores])
    assert abs(np.mean([s for s, _, _ in scores]) - 0.8) < 0.1


def test_only_long_texts(spark):
    draw = random.Random(4)
    make = lambda q: " ".join(f"{'good' if q else 'bad'}{draw.randrange(500)}" for _ in range(6000))
    rows = [(d, make(d % 2)) for d in range(60)]
    known = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = compression.train(df, known)
    assert model.share is None and min(len(t) for _, t in rows) > 32768
    assert all((r.score > 0.5) == r.doc_id % 2 for r in compression.classify(df, model).collect())


def test_scores_are_calibrated_at_any_sample(spark, monkeypatch):
    """The mean held-out score stays near the true share of good labels however few are sampled."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    share = np.mean([r.quality for r in labels.collect()])
    for size in (1000, 25):
        monkeypatch.setattr(compression, "SAMPLE", size)
        held = compression.classify(docs, compression.train(docs, labels)).join(labels, "doc_id").collect()
        assert abs(np.mean([r.score for r in held]) - share) < 0.05


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(16)] + [(3, 0, 0), (None, 1, 0), (4, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = compression.train(odd, labels)
    got = compression.classify(odd, model).collect()
    assert len(got) == odd.count()
    want = sorted((str(r.doc_id), zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0, round(by_hand(model, r.text), 9)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 9)) for r in got) == want
    assert compression.classify(empty, model).count() == 0
    only_good = compression.train(odd, labels.where("quality = 1"))
    assert {r.score for r in compression.classify(odd, only_good).collect()} == {1.0}
    none = compression.train(odd, labels.where("false"))
    assert {r.score for r in compression.classify(odd, none).collect()} == {0.5}
    learned = [k % 2 for k in range(16) if zlib.crc32(str(k).encode()) % 5]
    assert {r.score for r in compression.classify(odd, compression.train(empty, labels)).collect()} == {np.mean(learned)}


def test_logistic():
    draw = np.random.default_rng(0)
    x = np.column_stack([np.ones(4000), draw.normal(3, 2, 4000), draw.normal(0, 0.1, 4000)])
    w = np.array([0.5, -1.0, 8.0])
    y = (draw.random(4000) < 1 / (1 + np.exp(-x @ w))).astype(float)
    assert np.abs(compression.logistic(x, y) - w).max() < 1.0

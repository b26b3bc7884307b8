import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veristream.llm import suffix_tree as st
from veristream.llm import textops as tx

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or "")), None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def check_base(rows, docs):
    count = Counter(w for r in docs if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = []
    for r in docs:
        t = tokens(r.text)
        want.append((str(r.doc_id), held(r.doc_id), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == sorted(want)


class ByHand:
    """The whole tree by plain dictionaries."""

    def __init__(self, texts):
        self.grams = Counter(g for t in texts for m in range(1, st.DEPTH + 2) for g in zip(*(t[k:] for k in range(m)), strict=False))
        self.n, self.v = sum(map(len, texts)), sum(len(g) == 1 for g in self.grams)
        after = {}
        for g, c in self.grams.items():
            if len(g) > 1 and c >= st.LEAST:
                after.setdefault(g[:-1], {})[g[-1]] = c
        self.states = {s: following for s, following in after.items() if self.stays(s, following)}

    def stays(self, s, following):
        n, before = self.grams[s], self.grams[s[1:]] if len(s) > 1 else self.n
        q = {w: self.grams[(*s[1:], w)] / before for w in following}
        gain = sum(round(2 * c * math.log(c / (n * q[w])) * st.GAIN_PARTS) for w, c in following.items()) / st.GAIN_PARTS
        if rest := n - sum(following.values()):
            gain += 2 * rest * math.log(rest / (n * max(1 - sum(round(x * st.SHARE_PARTS) for x in q.values()) / st.SHARE_PARTS, 1e-12)))
        return gain > len(following) + st.DEVIATIONS * math.sqrt(2 * len(following))

    def probability(self, before, w):
        p = (self.grams[(w,)] + 1) / (self.n + self.v + 1)
        for k in range(1, min(st.DEPTH, len(before)) + 1):
            s = tuple(before[-k:])
            if s in self.states:
                n, following = self.grams[s], self.states[s]
                rest = n - sum(following.values())
                types = len(following) + rest
                p = (following.get(w, 0) + (types + rest) * p) / (n + types)
        return p

    def score(self, t):
        return sum(math.log10(self.probability(t[:k], w)) for k, w in enumerate(t))


def scores_by_hand(docs):
    model = ByHand([tokens(r.text) for r in docs if not held(r.doc_id)])
    return model, sorted((str(r.doc_id), round(model.score(tokens(r.text)), 6)) for r in docs)


def test_base(docs, odd, empty):
    for df in (docs, odd):
        check_base(st.score(df).collect(), df.select("doc_id", "text").collect())
    assert st.score(empty).count() == 0


@pytest.mark.parametrize("group_bytes, bucket_keys, fan", [(8 << 20, 2 << 20, None), (1000, 300, None), (30000, 1000, 5)])
def test_scores_by_brute_force(docs, odd, group_bytes, bucket_keys, fan):
    """In one group, in many groups and buckets with long texts in pieces, and in more buckets than a group sends rows to."""
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        model, want = scores_by_hand(rows)
        found = st.score(df, group_bytes=group_bytes, bucket_keys=bucket_keys, fan=fan).collect()
        assert len(model.states) > 20
        got = sorted((str(r.doc_id), round(r.score, 6)) for r in found)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)
        check_base(found, rows)


def test_no_training_documents(spark):
    ids = [d for d in range(100) if held(d)][:3]
    rows = st.score(spark.createDataFrame([(d, "a b a") for d in ids], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(4, 0, 0, 0.0, 0.0)] * 3


def test_probabilities_sum_to_one():
    """Over all words of the training texts and one unknown, after any words."""
    draw = random.Random(1)
    texts = [[*"".join(draw.choices(["abc", "dca", "b"], k=12)), None] for _ in range(20)]
    model = ByHand(texts)
    assert len(model.states) > 5
    for _ in range(50):
        before = draw.choices("abcdx", k=3)
        assert sum(model.probability(before, w) for w in [*"abcd", None, "unknown"]) == pytest.approx(1.0)


def test_pieces_hold_every_word_once():
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("ab \n\t") if draw.random() < 0.8 else "long" * draw.randint(1, 9) for _ in range(draw.randint(0, 60))).encode()
        words, lasts = [], []
        for lead, piece, last in st.pieces(text, draw.randint(1, 20)):
            mine = piece.split()
            assert mine[:lead] == words[len(words) - lead :]
            assert lead == min(st.DEPTH, len(words))
            words += mine[lead:]
            lasts.append(last)
        assert words == text.split() and lasts == [False] * (len(lasts) - 1) + [True]


def test_contexts_of_rare_words_are_learned(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(draw.choices(words, k=40))
    rows = [(d, " ".join(draw.choices(words, k=60))) for d in range(200)]
    ids = [d for d in range(1000, 2000) if not held(d)]
    rows += [(ids[0], passage), (ids[1], passage)]
    test_id = next(d for d in range(1000, 2000) if held(d))
    rows.append((test_id, passage))
    got = {r.doc_id: r for r in st.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fresh = [r for d, r in got.items() if d < 200 and r.held_out]
    gap = lambda r: (r.score - r.base_score) / r.n_tokens
    assert gap(got[test_id]) > max(map(gap, fresh)) + 1.0


def test_tree_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in st.op5_suffix_tree_scores(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    per_token = lambda name: sum(r[name] for r in rows) / sum(r.n_tokens for r in rows)
    assert per_token("score") > per_token("base_score") + 0.2


def test_word_hashes_tell_words_apart():
    draw = random.Random(3)
    words = {bytes(draw.choices(b"ab\x00", k=n)) for n in range(1, 40) for _ in range(200)}
    words |= {b"a" * n for n in (7, 8, 9, 15, 16, 17, 24, 1000)}
    once = sorted(words)
    spans = once + once[::-1]
    ends = np.cumsum([len(w) for w in spans])
    starts = ends - [len(w) for w in spans]
    hashes = tx.word_hashes(np.frombuffer(b"".join(spans), np.uint8), starts, ends)
    assert len(set(hashes.tolist())) == len(once)
    assert (hashes[: len(once)] == hashes[len(once) :][::-1]).all()
    none = np.zeros(0, np.int32)
    assert len(tx.word_hashes(np.zeros(0, np.uint8), none, none)) == 0


def test_words_that_another_hash_confuses(spark):
    """Two words of which only one is learned."""
    a, b = "=fmpm+%:_:=^r1qb", "\";@'^!_1[}3h4j(x"
    data = np.frombuffer((a + b).encode(), np.uint8)
    same = tx.word_hashes(data, np.array([0, 16]), np.array([16, 32]))
    assert same[0] == same[1]
    learned, unseen = next(d for d in range(100) if not held(d)), next(d for d in range(100) if held(d))
    df = spark.createDataFrame([(learned, f"{a} x"), (unseen, f"{b} x")], "doc_id long, text string")
    rows = st.score(df).collect()
    check_base(rows, df.collect())
    assert {r.doc_id: r.n_known for r in rows} == {learned: 3, unseen: 2}


def test_a_gram_that_shares_its_hash_leaves_probabilities(spark):
    """Two pairs of words of one hash: the sum of their counts is more than the context of one has."""
    names = np.array([f"w{k}" for k in range(3000)])
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    digests = tx.Words(data, np.array([0, len(data)])).digests()[0]
    pairs = tx.mix(digests[:, None] * np.uint64(0x9E3779B97F4A7C15) + digests).ravel() >> np.uint64(64 - st.SPARE_BITS - 24)
    order = np.argsort(pairs)
    same = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
    (a, b), (c, d) = next((p, q) for p, q in ((names[list(divmod(order[k + e], 3000))] for e in (0, 1)) for k in same) if len({*p, *q}) == 4)
    learned, unseen = next(k for k in range(100) if not held(k)), next(k for k in range(100) if held(k))
    rest = " ".join(f"x{k}" for k in range(100))
    df = spark.createDataFrame([(learned, f"{c} {d} {c} {d} {rest} {a} z {a} {b}"), (unseen, f"{a} y {c} y")], "doc_id long, text string")
    rows = st.score(df).collect()
    check_base(rows, df.collect())
    assert all(math.isfinite(r.score) and r.score <= 0 and r.score > r.base_score - 1 for r in rows)

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import oracle
from veristream.llm import variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return total


def by_hand(rows, min_length=6, min_count=5):
    words = {w: n for w, n in counted(rows).items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=5), min_size=1, max_size=30, unique=True), st.lists(st.text("abéz", min_size=1, max_size=6), min_size=1, max_size=8, unique=True))
def test_automata_and_trie(known, asked):
    """Each neighbour exactly once, whatever runs of equal letters there are."""
    known = sorted(k.encode("latin-1") for k in known)
    trie = variants.unpacked_trie(variants.packed_trie(known, np.arange(len(known)) + 1))
    assert [variants.spelled(trie, k) for k in trie.ends[np.argsort(trie.n[trie.ends])]] == known
    who, node = variants.neighbours(trie, [a.encode("latin-1") + b"\0" for a in asked])
    got = sorted((asked[w], variants.spelled(trie, k).decode("latin-1")) for w, k in zip(who.tolist(), node.tolist(), strict=True))
    assert got == sorted((a, k.decode("latin-1")) for a in asked for k in known if is_near(a, k.decode("latin-1")))


@pytest.mark.parametrize("shard_bytes, round_bytes", [(4 << 20, 32 << 20), (60, 400)])
def test_against_brute_force(spark, monkeypatch, shard_bytes, round_bytes):
    """In one shard, and in many shards and rounds."""
    draw = random.Random(4)
    base = ["".join(draw.choices("abcäé", k=draw.randint(2, 7))) for _ in range(12)]
    words = base + [w[:k] + draw.choice("abcäéÿ") + w[k + draw.randint(0, 1) :] for w in base for k in range(3)]
    weight = [5 ** draw.randint(0, 5) for _ in words]
    rows = [(k if k % 9 else None, draw.choice([" ", "-", "1", "日", "_"]).join(w.upper() if draw.random() < 0.1 else w for w in draw.choices(words, weight, k=80))) for k in range(120)]
    # A chain of four forms.
    rows += [(500 + k, "qrstuvwx"[: 4 + k] + " " + ("qrstuvwx"[: 4 + k] + " ") * (2 * 7**k)) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = variants.near_words
    monkeypatch.setattr(variants, "near_words", lambda words: near(words, shard_bytes, round_bytes))
    got = result(variants.spelling_variants(df, 3, 2))
    assert got == by_hand(rows, 3, 2)
    assert ("qrst", "qrstuvwx") in {(r[0], r[5]) for r in got}


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(variants.spelling_variants(odd)) == by_hand(rows)
    assert variants.spelling_variants(empty).count() == 0
    long = [(1, ("z" * 70000 + " ") * 5 + ("z" * 70001 + " ") * 30), (None, None), (2, "ÀÉÎÕÜß × ÷÷÷÷÷÷ ÿ" * 6)]
    df = spark.createDataFrame(long, "doc_id long, text string")
    assert result(variants.spelling_variants(df)) == by_hand(long)


def test_misspelt_runs(spark):
    """Enough runs that some lose a letter, of one or two bytes."""
    draw = random.Random(6)
    words = ["straße", "élèves", "orange", "señores", "aaaaaaa"]
    rows = [(k, " ".join(draw.choices(words, k=4))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(variants.spelling_variants(df, 5, 1))
    assert got == by_hand(rows, 5, 1) and len(got) > 12


def test_query_equals_its_sql(spark, sf_dir):
    oracle.same(variants.op13_spelling_variants(spark, sf_dir), oracle.connect(sf_dir), variants.ORACLE_SQL)

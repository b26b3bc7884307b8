import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import oracle
from veristream.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = 2**63 - 1


def by_hand(rows, window):
    first = {}
    docs = [(LAST if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, words in docs:
        for k in range(len(words) - window + 1):
            g = tuple(words[k : k + window])
            first[g] = min(first.get(g, (d, k)), (d, k))
    out = []
    for (d, words), (own, _) in zip(docs, rows, strict=True):
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < (d, k) for j in range(window)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(own), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    rows = df.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha"), "removed_from", "removed_to").collect()
    for r in rows:
        assert sum(b - a for a, b in zip(r.removed_from, r.removed_to, strict=True)) == r.n_removed
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.sha) for r in rows)


@pytest.mark.parametrize("group_bytes, bucket_keys, fan", [(8 << 20, 1 << 20, None), (600, 50, None), (300, 20, 4)])
def test_against_brute_force(spark, group_bytes, bucket_keys, fan):
    """In one group and bucket, in many, and in more buckets than a group sends rows to."""
    draw = random.Random(group_bytes)
    passages = [[draw.choice("abcdefgh") for _ in range(draw.randint(8, 30))] for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        while len(words) < draw.randint(0, 90):
            words += draw.choice(passages) if draw.random() < 0.5 else draw.choices("abcdefghijklmnop", k=draw.randint(1, 12))
        rows.append((k * 3 % 61, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.deduplicate(df, window=6, group_bytes=group_bytes, bucket_keys=bucket_keys, fan=fan)) == by_hand(rows, 6)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(substrings.deduplicate(odd, group_bytes=2000, bucket_keys=200)) == by_hand(rows, 20)
    cut = substrings.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    untouched = {r.doc_id for r in substrings.deduplicate(odd).where("n_removed = 0").select("doc.doc_id").collect()}
    for r in cut.where(F.col("doc_id").isin(1, 2, 3)).collect():
        assert r.doc_id in untouched and r.text in ("", " \n\t ", "one")
    assert substrings.deduplicate(empty).count() == substrings.without_repeats(empty).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    oracle.same(substrings.op3_substring_dedup(spark, sf_dir), oracle.connect(sf_dir), substrings.ORACLE_SQL)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_a_polynomial_confuses(spark):
    """Two long words that a polynomial modulo 2^64 can't tell apart."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(substrings.deduplicate(df))
    assert got == by_hand(rows, 20) and [r[2] for r in got] == [0, 0, 20]


def test_what_is_left_keeps_its_lines(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(1, passage), (2, f"title  line\n\n{passage}\nnext\tline\n"), (3, f"{passage}\n\nend "), (4, f" é {passage}"), (5, None), (6, "a\n b ")]
    got = {r.doc_id: (r.text, r.n_chars) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars")).collect()}
    want = {1: passage, 2: "title  line\n\nnext\tline\n", 3: "end ", 4: " é ", 5: None, 6: "a\n b "}
    assert got == {d: (t, None if t is None else len(t)) for d, t in want.items()}


def test_many_rows_without_id_or_words(spark):
    draw = random.Random(7)
    passage = " ".join(f"w{k}" for k in range(25))
    rows = [(None, None)] * 300 + [(None, "few words")] * 300 + [(None, f"{passage} {draw.random()}") for _ in range(50)] + [(4, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(substrings.deduplicate(df, group_bytes=500, bucket_keys=50))
    assert got == by_hand(rows, 20)


@pytest.mark.parametrize("group_bytes, fan", [(16, None), (16, 3), (400, None), (8 << 20, None)])
def test_result_does_not_depend_on_groups(spark, group_bytes, fan):
    """Null, repeated and identical ids, at equal and unequal starts."""
    passage, other = (" ".join(f"{c}{k}" for k in range(20)) for c in "pq")
    rows = [(None, f"{passage} {k}") for k in range(3)] + [(None, f"z {passage}")]
    rows += [(1, f"{other} a"), (1, f"b b b b b b {other}"), (1, f"{other} c"), (2, f"{other}"), (0, "short")]
    rows += [(7, f"{passage} {other}")] * 40 + [(7, None), (9, f"{other} {passage} {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    run = lambda: result(substrings.deduplicate(df, group_bytes=group_bytes, bucket_keys=9, fan=fan))
    assert run() == run() == by_hand(rows, 20)


def test_memory_of_a_group():
    """A group of 8 MB: arrays that a step needs no longer don't wait for its end."""
    draw = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(10000)])
    texts = [" ".join(words[draw.integers(0, len(words), 4000)]) for _ in range(350)]
    docs = pa.table({"doc": pa.array([{"doc_id": k, "text": t} for k, t in enumerate(texts)], pa.struct([("doc_id", pa.int64()), ("text", pa.string())]))})
    none = pa.table({"keys": pa.array([], pa.binary())})
    steps = substrings.Steps(20, 12, True)
    for most, run in ((140 << 20, lambda: steps.probe([pa.scalar(0)], docs)), (155 << 20, lambda: steps.cut([pa.scalar(0)], docs, none))):
        tracemalloc.start()
        assert run().num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, f"{peak >> 20} MB"

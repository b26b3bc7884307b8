import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import oracle
from veristream.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def longest_by_hand(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=40), min_size=1, max_size=6))
def test_longest_repeats(rows):
    symbols = np.array([hash((r, w)) & (2**63 - 1) for r, ws in enumerate(rows) for w in ws], np.uint64)
    ends = np.cumsum([len(ws) for ws in rows])
    end = np.repeat(ends, [len(ws) for ws in rows])
    want = [k for ws in rows for k in longest_by_hand(ws)]
    got = quality.longest_repeats(symbols, end).tolist() if len(symbols) else []
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #\n\té日 ", max_size=80)), min_size=1, max_size=5))
def test_base_figures(texts):
    got = quality.assess(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert got["n_words"][k] == len(words)
        assert got["word_chars"][k] == sum(map(len, words))
        assert got["n_symbols"][k] == sum(text.count(c) for c in "#*$%&|<>")
        assert got["n_dup_lines"][k] == len(lines) - len(set(lines))
        assert got["n_repeat_words"][k] == len(inside)
        assert got["base_failed"][k] == (len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_query_equals_its_sql(spark, sf_dir):
    oracle.same(quality.op2_quality_repetition(spark, sf_dir), oracle.connect(sf_dir), quality.ORACLE_SQL)


def test_a_long_repeat_is_rejected_without_many_windows():
    fresh = [f"u{k}" for k in range(300)]
    text = " ".join([*fresh[:60], *(f"v{k}" for k in range(180)), *fresh[:60]])
    got = quality.assess(pa.array([text, " ".join(fresh)]), max_covered=0.9)
    assert got["longest_repeat"].tolist() == [60, 0]
    assert got["kept"].tolist() == [False, True]


def test_the_limits_bind_below_the_base_rule(spark):
    fresh = [f"u{k}" for k in range(2000)]
    passage = " ".join([*fresh[:180], *fresh[180:1820], *fresh[:180]])
    short = " ".join([*fresh[:51], *fresh[51:1949], *fresh[:51]])
    many = " ".join([*fresh[:1600], *(w for k in range(160, 0, -40) for w in fresh[k - 40 : k])])
    got = quality.assess(pa.array([passage, short, many, " ".join(fresh)]))
    assert not got["base_failed"].any()
    assert got["kept"].tolist() == [False, False, False, True]
    rows = spark.createDataFrame([(0, passage), (1, " ".join(fresh))], "doc_id long, text string")
    assert [r.doc_id for r in quality.quality_filter(rows).collect()] == [1]


def test_odd_rows(odd, empty, as_table, spark):
    folder = as_table(odd)
    con = oracle.connect(folder, documents=odd.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    oracle.same(quality.op2_quality_repetition(spark, folder), con, quality.ORACLE_SQL)
    kept = quality.quality_filter(odd)
    assert kept.schema == odd.schema and kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert quality.quality_filter(empty).count() == quality.quality_report(empty).count() == 0


def test_words_that_a_polynomial_confuses():
    """Long words that a polynomial modulo 2^64 can't tell apart are different words, and different lines."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    text = " ".join(f"{a if k < 9 else b} u{k % 9}" for k in range(18)) + f"\n{a}\n{b}"
    got = quality.assess(pa.array([text]))
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert got["n_repeat_words"].tolist() == [len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})]
    assert got["n_dup_lines"].tolist() == [0] and got["longest_repeat"].tolist() == [max(longest_by_hand(words))]


def test_kept_is_decided_below_the_base_rule(spark, as_table):
    """The query's verdict differs from the base rule's, as its SQL's does."""
    fresh = [f"u{k}" for k in range(700)]
    rows = [(0, " ".join([*fresh, *fresh[:51]])), (1, " ".join([*fresh, *fresh[:50]])), (2, " ".join(fresh)), (3, None)]
    folder = as_table(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.op2_quality_repetition(spark, folder).collect()}
    assert got == {0: (False, False), 1: (False, True), 2: (False, True), 3: (True, False)}
    con = oracle.connect(folder)
    oracle.same(quality.op2_quality_repetition(spark, folder), con, quality.ORACLE_SQL)

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tests import oracle
from veristream.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, max_n=3, min_count=10, cover=50, top=2000):
    """Rows of lang, text."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[k : k + size])) for size in range(1, max_n + 1) for k in range(len(words) - size + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= min_count}
    out = {}
    for (lang, words), a in found.items():
        score, _, l, r = min((10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
        inside = lambda longer: any(longer[k : k + len(words)] == words for k in range(len(longer) - len(words) + 1))  # noqa: E731, B023
        if not any(o == lang and len(longer) > len(words) and 100 * f >= cover * a and inside(longer) for (o, longer), f in found.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, ranked in out.items() for k, (s, a, p, l, r) in enumerate(sorted(ranked)[:top]))


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("max_n, min_count, cover, top", [(3, 3, 50, 2000), (5, 2, 70, 2000), (2, 4, 50, 2000), (4, 2, 30, 7)])
def test_against_brute_force(spark, monkeypatch, max_n, min_count, cover, top):
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 500)
    draw = random.Random(max_n)
    words = ["a", "b", "c", "De", "é", "日本", "x|y", "\u0085", "-"]
    rows = []
    for _ in range(150):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ! "]) for _ in range(draw.randrange(60)))
        rows.append((draw.choice(["en", "en", "und", None, ""]), text))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert result(collocations.collocations(df, max_n, min_count, cover, top)) == by_hand(rows, max_n, min_count, cover, top)


def test_stretches_of_a_long_text(monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["a", "b", "c", "d.", "e"], k=n)) for n in (500, 3, 0, 700)]

    def counted():
        total = Counter()
        for bucket, table in collocations.grams(pa.array(["x", "y", "x", "x"]), pa.array(texts), 3, 4):
            for r, b in zip(table.to_pylist(), bucket.tolist(), strict=True):
                total[r["lang"], r["phrase"], r["size"], b] += r["f"]
        return total

    whole = counted()
    monkeypatch.setattr(collocations, "STRETCH", 7)
    assert counted() == whole and len({key[:3] for key in whole}) == len(whole)


def test_odd_rows(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert result(collocations.collocations(odd)) == by_hand(rows)
    assert collocations.collocations(empty).count() == 0
    assert result(collocations.collocations(spark.createDataFrame([(None, None)] * 3, "lang string, text string"))) == []


def test_counts_beyond_64_bits(spark, monkeypatch):
    """The square of a count times the unit, and the product of the parts' counts, pass 64 bits."""
    n = 5_000_000_019
    counted = [("en", "", 0, 3 * n), ("en", "a", 1, n + 7), ("en", "b", 1, n + 1), ("en", "a b", 2, n)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: spark.createDataFrame(counted, collocations.COUNTED))
    assert result(collocations.collocations(spark.range(1))) == [("en", 1, "a b", n, n + 7, n + 1, 3 * n, 10**6 * n * n // ((n + 7) * (n + 1)))]


def test_query_equals_its_sql(spark, sf_dir):
    oracle.same(collocations.op11_collocations(spark, sf_dir), oracle.connect(sf_dir), collocations.ORACLE_SQL)

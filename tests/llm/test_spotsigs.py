import hashlib
import re

import pytest
from pyspark.sql import functions as F

from veristream.llm import spotsigs

SPLIT = re.compile("[ \t-\r]+")


def anchors_by_hand(texts):
    count = {}
    for t in texts:
        for w in SPLIT.split((t or "").lower()):
            if 0 < len(w) <= 4 and w.isalpha():
                count[w] = count.get(w, 0) + 1
    return sorted(count, key=lambda w: (-count[w], w.encode()))[:64]


def signatures_by_hand(text, anchors):
    words = [w for w in SPLIT.split(text.lower()) if w]
    content = [w for w in words if w not in anchors]
    out, seen = set(), 0
    for w in words:
        if w in anchors:
            if seen + 1 < len(content):
                out.add((w, content[seen], content[seen + 1]))
        else:
            seen += 1
    return out or {tuple(words)}


def order(rows):
    """Descending doc_id, then text; no doc_id comes last."""
    return sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), (r.text or "").encode()))


@pytest.mark.parametrize("buckets", [0, 4, 80])
def test_against_brute_force(docs, odd, monkeypatch, buckets):
    monkeypatch.setattr(spotsigs, "isqrt", lambda n: buckets)
    for df in (docs, odd):
        rows = order(df.select("doc_id", "text").collect())
        common = set(spotsigs.anchors(df))
        assert common == set(anchors_by_hand(r.text for r in rows))
        want = []
        for k, r in enumerate(rows):
            text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
            half = len(text) // 2
            changed = text[: len(text) - half] + after[:half]
            a, b, c = (signatures_by_hand(t, common) for t in (text, changed, after))
            want.append((str(r.doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)))
        got = spotsigs.edited(df).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
        for r in got:
            assert len(r.fingerprint) % 8 == 0 and r.fingerprint and re.fullmatch("[0-9a-f]*", r.fingerprint + r.edited_fingerprint)
        of = {}
        for r, t in zip(sorted(got, key=lambda r: (str(r.doc_id), r.edited_sha256)), sorted(zip(rows, want, strict=True), key=lambda x: (x[1][0], x[1][2])), strict=True):
            assert of.setdefault(t[0].text or "", r.fingerprint) == r.fingerprint


def test_one_row_and_none(spark, docs, empty):
    one = spotsigs.edited(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.edited(empty).count() == 0


def links_by_hand(rows, common, threshold):
    """Class of each document (by its place), smallest ids of classes, and pairs of classes."""
    sets = [frozenset(signatures_by_hand(t or "", common)) for _, t in rows]
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        least[s] = min((x for x in (d, least.get(s)) if x is not None), default=None)
    each = list(least)
    pairs = [(x, y) for k, x in enumerate(each) for y in each[:k] if len(x & y) >= threshold * len(x | y)]
    return sets, least, pairs


def test_near_duplicates(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        sets, least, pairs = links_by_hand(rows, set(spotsigs.anchors(df)), 0.6)
        links = {s: sum(s in p for p in pairs) for s in least}
        want = sorted(str((d, least[s], links[s])) for (d, _), s in zip(rows, sets, strict=True))
        assert sorted(str(tuple(r)) for r in spotsigs.linked(df, 0.6).collect()) == want
        found = spotsigs.near_duplicates(df, 0.6)[1].collect()
        assert len(found) == len({frozenset((r.a, r.b)) for r in found}) == len(pairs)
        assert pairs or df is odd
    assert spotsigs.linked(empty).count() == 0


def shuffled_rows(spark):
    """Rows that all stages so far have written for exchanges."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_signatures_travel_twice(spark, docs):
    """To be counted, and to be joined with their counts; what no two sets share goes no further."""
    texts = docs.select("doc_id", "text")
    places = spotsigs.with_signatures(texts.withColumn("text", F.coalesce("text", F.lit(""))), "text", "sigs", spotsigs.anchors(docs)).select(F.sum(F.size("sigs"))).first()[0]
    before, limit = shuffled_rows(spark), "spark.sql.autoBroadcastJoinThreshold"
    small = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as for tables that are too large for a broadcast
    try:
        assert len(spotsigs.linked(docs).collect()) == docs.count()
    finally:
        spark.conf.set(limit, small)
    rows = shuffled_rows(spark) - before
    assert 0 < rows < 4 * places, rows / places


@pytest.mark.parametrize("often", [1, 10**9])
def test_frequent_signatures_are_dealt_out(spark, monkeypatch, often):
    """None and all of the shared signatures are broadcast: the same links.  Two sets at the threshold exactly, one below it."""
    monkeypatch.setattr(spotsigs, "OFTEN", often)
    words = [f"the word{k:02d} tail{k:02d}" for k in range(20)]
    texts = [" ".join(words[:k]) for k in (10, 8, 7)] * 2 + ["the other text here"] + [None, ""]
    got = spotsigs.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.8).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {0: (0, 1), 3: (0, 1), 1: (1, 2), 4: (1, 2), 2: (2, 1), 5: (2, 1), 6: (6, 0), 7: (7, 0), 8: (7, 0)}


def test_only_dataframe_functions(docs):
    for df in (spotsigs.edited(docs), spotsigs.linked(docs)):
        assert not re.search("Python|Pandas|Arrow|InArrow", df._jdf.queryExecution().toString())


def test_bounds_are_one_constant(docs):
    """The plan doesn't grow with the buckets."""
    size = lambda n: len(docs.select(spotsigs._bucket([float(k) for k in range(n)]))._jdf.queryExecution().optimizedPlan().treeString().splitlines())
    assert size(9) == size(10000)
    got = docs.select("doc_id", spotsigs._bucket([k * 1.5 for k in range(100)]).alias("b")).collect()
    assert all(r.b == sum(k * 1.5 <= r.doc_id for k in range(100)) for r in got)


def test_words(docs):
    assert docs.select(spotsigs.words_of(F.lit(" A\tb\n"))).first()[0] == ["a", "b"]

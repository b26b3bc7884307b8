import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veristream.llm import languages as lang

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    """Counts of a text's features, one by one."""
    counts = np.zeros(lang.DIM)
    data = text.translate(UPPER).encode()
    words = bytes(b if not lang.BREAK[b] else 0x20 for b in data).split()
    for word in words:
        padded = b" " + word + b" "
        for k in range(len(word)):
            a, b, c = padded[k : k + 3]
            counts[int(lang.tx.mix(np.array([a << 16 | b << 8 | c], np.uint64))[0]) % lang.DIM] += 1
        whole = lang.tx.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        counts[int(whole[0]) % lang.DIM] += 1
    return counts


def by_hand(model, text):
    """Language and score, duel by duel."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    counts = features(text)
    p = {d: 1 / (1 + np.exp(-np.clip(model.slope[k] * (counts @ model.weights[:, k] / max(1, counts.sum()) + model.bias[k]) + model.level[k], -40, 40))) for k, d in enumerate(model.duels)}

    def winner(family, sides):
        odds = {s: [p[d] if d.first == s else 1 - p[d] for d in model.duels if d.family == family and s in (d.first, d.second)] for s in sides}
        best = max(sides, key=lambda s: (sum(x > 0.5 for x in odds[s]), sum(odds[s])))
        return best, min(odds[best], default=1.0)

    family, a = winner(None, list(model.families))
    best, b = winner(family, model.families[family])
    return best, min(a, b)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, lang.train(docs)


def test_held_out_accuracy(trained):
    docs, model = trained
    assert [str(d.family) for d in model.duels] == ["None", "germanic", "romance"]
    got = lang.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and got["score"].mean() > 0.95
    # Texts of a few letters are often wrong, and their scores say so.
    short = docs.where("lang IN ('de', 'en')").withColumn("text", F.regexp_extract("text", "^.{6}", 0))
    got = lang.identify(short, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").toPandas()
    right = got["lang"] == got["lang_pred"]
    assert 0.5 < right.mean() < 1 and got.loc[right, "score"].mean() > got.loc[~right, "score"].mean()


def test_against_brute_force(trained):
    _, model = trained
    draw = random.Random(1)
    texts = ["".join(draw.choices(["the", "der", "Élève", "ñ", " ", " ", "1", "日本", "\n", "x"], k=draw.randrange(30))) for _ in range(80)] + [None, "", "12 %", "²", "١٢", "Ω", "a" * 300]
    langs, score = model.predict(pa.array(texts, pa.string()))
    for text, got, p in zip(texts, langs, score.tolist(), strict=True):
        want, q = by_hand(model, text)
        assert got == want and abs(p - q) < 1e-9


def test_a_text_is_counted_in_stretches(monkeypatch):
    text = " ".join(random.Random(2).choices(["le", "eau", "straße", "日本"], k=999))
    whole = lang.tally(pa.array([text, "a b"]))
    monkeypatch.setattr(lang, "STRETCH", 10)
    assert (lang.tally(pa.array([text, "a b"])) == whole).all() and (whole[0] == features(text)).all()


def test_vector_machine_and_blocks():
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(1, 0.3, (40, 2)), draw.normal(-1, 0.3, (40, 2))])
    y = np.repeat([1.0, -1.0], 40)
    assert (np.sign(x @ lang.vector_machine(x, y)) == y).all()
    text = "".join(f"{k:05d}" for k in range(20000))
    drawn = lambda t, seed: lang.tx.drawn(t, seed, lang.BLOCKS, lang.BLOCK)
    assert drawn("short", 1) == "short" and drawn(text, 7) == drawn(text, 7)
    blocks = drawn(text, 7).split(" ")
    assert len(blocks) == lang.BLOCKS and all(b in text for b in blocks) and text.index(blocks[-1]) > len(text) // 2


def test_long_texts_are_learned_from(spark):
    draw = random.Random(3)
    rows = [(k, f"l{k % 2}", " ".join(draw.choices(["abc", "def"] if k % 2 else ["xyz", "uvw"], k=20000))) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = lang.identify(df, lang.train(df))
    assert {(r.doc_id, r.lang_pred) for r in got.collect()} == {(k, f"l{k % 2}") for k in range(24)}


def test_odd_rows(spark, odd, empty):
    got = lang.identify(odd, lang.train(odd)).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} == {"en", "und"} and {r.score for r in got} == {0.0, 1.0}
    assert all(r.lang_pred == "und" and r.score == 0 for r in lang.identify(odd, lang.train(empty)).collect())
    assert lang.identify(empty, lang.train(odd)).count() == 0
    null_ids = odd.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.when(F.length("text") % 2 == 0, "en").otherwise("xx"))
    model = lang.train(null_ids)
    assert set(model.families) == {"germanic", "xx"} and lang.identify(null_ids, model).count() == odd.count()


def test_held_out_rows_are_not_seen(spark, trained):
    docs, model = trained
    other = docs.withColumn("lang", F.when(lang.fold(F.col("doc_id")) == lang.HELD_OUT, "zz").otherwise(F.col("lang")))
    again = lang.train(other)
    assert (again.weights == model.weights).all() and again.duels == model.duels


def test_query(spark, sf_dir):
    df = lang.op12_language_families(spark, sf_dir)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "pmod(crc32(string(doc_id)), 4) = 2 AS held_out").collect()
    assert sorted((r.doc_id, r.held_out) for r in df.collect()) == sorted(map(tuple, want))

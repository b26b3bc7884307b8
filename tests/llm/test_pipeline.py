"""Every stage against brute force on its own input, and the whole run."""

import hashlib
import re
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tests.llm import test_bpe, test_mixing, test_similar, test_substrings
from veristream.llm import mixing, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def stages(spark, docs, folder, tmp_path):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(out)
        after = spark.read.parquet(out)
        yield name, docs, after
        docs = after


def check_stages(spark, docs, folder, tmp_path):
    """Rows, not only ids, against brute force.  Columns without an order are compared as text."""
    for name, before, after in stages(spark, docs, folder, tmp_path):
        old, new = before.collect(), after.collect()
        if name != "op1_bpe":
            assert after.columns == docs.columns
        if name.startswith("op2"):
            kept = [r for r in old if quality.assess(pa.array([r.text], pa.string()))["kept"][0]]
            assert sorted(map(str, new)) == sorted(map(str, kept)) and 0 < len(new) < len(old)
        elif name.startswith("op9"):
            test_similar.check_kept([(r.doc_id, r.text) for r in new], [(r.doc_id, r.text) for r in old])
            assert {str(r) for r in new} <= {str(r) for r in old}
        elif name.startswith("op3"):
            want = test_substrings.by_hand([(r.doc_id, r.text) for r in old], 20)
            got = sorted((str(r.doc_id), hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in new)
            assert got == sorted((d, sha) for d, _, _, sha in want)
            cut = {d for d, _, gone, _ in want if gone}
            assert {str(r) for r in new if str(r.doc_id) not in cut} == {str(r) for r in old if str(r.doc_id) not in cut}
            assert all(r.n_chars == len(r.text) for r in new if str(r.doc_id) in cut)
        elif name.startswith("op6"):
            rows = mixing.mixture(before).collect()
            test_mixing.check(rows, old)
            copies = Counter({(str(r.doc_id), r.text_hash): r.copies for r in rows})
            assert sum(copies.values()) == len(new)
            assert Counter(map(str, new)).keys() <= {str(r) for r in old}
            assert Counter(str(r.doc_id) for r in new) == Counter(d for d, _ in copies.elements())
        else:
            encoded = [(r, test_bpe.library().encode(r.text or "", add_special_tokens=False).ids) for r in old]
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            want = sorted(str((r.doc_id, r.text, ids, len(ids), sha(",".join(map(str, ids))), sha(test_bpe.library().decode(ids, skip_special_tokens=False)))) for r, ids in encoded)
            assert sorted(str((r.doc_id, r.text, list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in new) == want


def test_stages(spark, docs, sf_dir, tmp_path):
    check_stages(spark, docs, sf_dir, tmp_path)


def test_stages_on_odd_rows(spark, odd, as_table, tmp_path):
    """Nulls, repeated rows and ids, ties, clashing names."""
    folder = as_table(odd)
    check_stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder, tmp_path)


def test_run(spark, sf_dir, odd, empty, as_table):
    """The rows of the stages run one by one; reruns agree."""
    for folder in (sf_dir, as_table(odd)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        key = lambda df: sorted(str((r.doc_id, r.text, list(r.ids))) for r in df.collect())
        assert key(corpus_pipeline.run(spark, folder)) == key(docs) and docs.count() > 0
    assert corpus_pipeline.run(spark, as_table(empty)).count() == 0


def test_batches(spark, docs, sf_dir):
    """Batches are bounded by their bytes in all stages, not only by 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('abcdefgh', 256) AS text")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        stage(spark, docs, sf_dir)
        sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) <= 2 << 20

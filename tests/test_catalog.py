import pytest

import __spark_entry__ as entry
from veristream.plans import catalog, evidence

from . import oracle


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.same(catalog.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), catalog.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, sf_dir):
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    same = lambda a, b: oracle.rows(a.toPandas()) == oracle.rows(b.toPandas())
    assert same(run("streaming_guard"), run("guard_decisions"))
    assert same(run("streaming_guard_null_norms"), run("guard_null_norms"))
    assert same(run("streaming_keep_window"), run("keep_window_extend").where("kept").drop("kept"))
    assert same(run("streaming_chain"), evidence.chain(spark, sf_dir))
    assert evidence.V.chain_breaks(run("streaming_chain")).where("first_break IS NOT NULL").count() == 0


def test_literals_are_as_python_writes_them(spark):
    from pyspark.sql import functions as F

    from veristream.functions.exprs import decision_literal

    df = spark.createDataFrame([("a", 0.0001), ("b", 1e-5), ("c", 0.5), ("d", None)], "action string, x double")
    got = [r[0] for r in df.coalesce(1).select(decision_literal(F.col("action"), F.col("x"))).collect()]
    assert got == ['{"action":"a","confidence":0.0001}', '{"action":"b","confidence":1e-05}', '{"action":"c","confidence":0.5}', '{"action":"d","confidence":null}']


def test_merkle_roots(spark):
    import hashlib

    from veristream.operators.verify import merkle_roots

    sha = lambda b: hashlib.sha256(b).digest()
    for n in (1, 2, 3, 5, 8):
        contents = [sha(bytes([k])).hex() for k in range(n)]
        level = [sha(b"\0" + f"f{k}".encode() + b"\0" + bytes.fromhex(c)) for k, c in enumerate(contents)]
        while len(level) > 1:
            level = [sha(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        leaves = spark.createDataFrame([("g", f"f{k}", c) for k, c in enumerate(contents)], "g string, path string, h string")
        assert merkle_roots(leaves, "g", "path", "h").first().root == level[0].hex()


def test_span_verdicts_are_found_by_comparison(spark):
    texts = ["", "é", "ab", "short", "日本語" * 30, "!" * 100, None]
    rows = [(6 * k + r, t) for k, t in enumerate(texts) for r in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.matches for r in evidence.span_matches(docs).collect()}
    assert got == {d: d % 6 != 0 for d, _ in rows}

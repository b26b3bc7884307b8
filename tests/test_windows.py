"""Window formulations against the state machines they stand for, on random schedules."""

import random

import pytest
from pyspark.sql import functions as F

from veristream.operators import guard as G
from veristream.operators import windows as W


def machine(n, triggers, pre, post, extending):
    buffer, left, kept = [], 0, []
    for frame in range(n):
        if frame in triggers:
            if not left:
                kept += buffer
                buffer, left = [], post
            elif extending:
                left = post
        if left:
            kept.append(frame)
            left -= 1
        else:
            buffer = [*buffer, frame][-pre:] if pre else []
    return set(kept)


def test_keep_windows(spark):
    draw = random.Random(11)
    sessions = {s: (draw.randint(1, 60), set()) for s in range(60)}
    for s, (n, triggers) in sessions.items():
        triggers.update(draw.sample(range(n), min(n, draw.randint(0, 6))))
    frames = spark.createDataFrame([(s, f, f in t) for s, (n, t) in sessions.items() for f in range(n)], "session long, frame_id long, trigger boolean")
    for pre, post in ((2, 3), (0, 1), (5, 1), (3, 8)):
        for extending in (True, False):
            keep = W.keep_extending if extending else W.keep_latched
            got = {}
            for r in keep(frames, F.col("trigger"), pre, post).where("kept").collect():
                got.setdefault(r.session, set()).add(r.frame_id)
            for s, (n, triggers) in sessions.items():
                assert got.get(s, set()) == machine(n, triggers, pre, post, extending), (s, pre, post, extending)


def test_trigger_after_the_last_frame_keeps_history(spark):
    frames = spark.createDataFrame([(1, f) for f in range(10)], "session long, frame_id long")
    triggers = spark.createDataFrame([(1, 10)], "session long, trigger long")
    assert {r.frame_id for r in W.keep_by_triggers(frames, triggers, 3, 2).collect()} == {7, 8, 9}


def test_guard_fails_closed(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(1, "a", 1.0), (2, "a", 1.0000001), (3, "a", nan), (4, "a", inf), (5, "z", 0.1), (6, "a", None), (7, "a", -inf), (8, None, 0.1), (9, "b", 0.1), (10, "c", 0.1)]
    frames = spark.createDataFrame([(s, 0, a, n) for s, a, n in cases], "session long, frame_id long, action string, norm double")
    envelope = spark.createDataFrame([("a", 1.0), ("b", nan), ("c", inf)], "action string, bound double")
    got = {r.session: (r.verdict, r.reason) for r in G.decide(frames, envelope).collect()}
    odd = ("ESTOP", "non-finite norm")
    none = ("ESTOP", "no bound")
    assert got == {1: ("PERMIT", "within envelope"), 2: ("ESTOP", "norm exceeds bound"), 3: odd, 4: odd, 5: none, 6: odd, 7: odd, 8: none, 9: none, 10: none}


def test_touching_windows_by_triggers(spark):
    """Two windows that touch are one run of frames, and still two windows by their triggers."""
    frames = spark.createDataFrame([(1, f) for f in range(40)], "session long, frame_id long")
    triggers = spark.createDataFrame([(1, 10), (1, 15)], "session long, trigger long")
    runs = W.brackets(W.keep_by_triggers(frames, triggers, 0, 5)).collect()
    assert [(r.first_frame, r.last_frame) for r in runs] == [(10, 19)]
    windows = W.trigger_windows(frames, triggers, 0, 5).orderBy("first_frame").collect()
    assert [(r.trigger, r.first_frame, r.last_frame, r.frames) for r in windows] == [(10, 10, 14, 5), (15, 15, 19, 5)]
    assert [r.frames for r in W.trigger_windows(frames, triggers, 12, 40).orderBy("trigger").collect()] == [40, 37]


def run_batches(spark, folder, batches, make):
    """A stream of one micro-batch after the other; all rows that it gives."""
    import os

    out = []
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        from veristream.streaming.guard import write_once

        write_once(make(stream), f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        assert os.path.exists(f"{folder}/out/batch={k}")
        out.append(spark.read.parquet(f"{folder}/out/batch={k}").drop("batch").orderBy("session", "frame_id").collect())
    return out


def test_guard_over_batches(spark, tmp_path):
    """The latch lasts from batch to batch, late frames are a breach, an ended session stays ended."""
    from veristream.streaming import guard as S

    frame = "session long, frame_id long, action string, norm double, ended boolean"
    batches = [
        [(1, 0, "a", 0.5, False), (2, 0, "a", 9.0, False), (3, 5, "a", 0.5, False), (4, 0, "a", None, True)],
        [(1, 1, "a", 0.5, False), (2, 1, "a", 0.5, False), (3, 4, "a", 0.5, False), (4, 1, "a", 0.5, False)],
        [(1, 2, "a", 0.5, True), (1, 3, "a", 9.0, None), (4, 1, "a", 0.5, None)],
    ]
    made = [spark.createDataFrame(b, frame) for b in batches]
    got = run_batches(spark, str(tmp_path), made, lambda s: S.guard(s, {"a": 1.0}))
    assert [[(r.session, r.reason) for r in b] for b in got] == [
        [(1, "within envelope"), (2, "norm exceeds bound"), (3, "within envelope"), (4, "non-finite norm")],
        [(1, "within envelope"), (2, "prior breach"), (3, "out of order"), (4, "session ended")],
        [(1, "within envelope"), (1, "session ended"), (4, "session ended")],
    ]
    assert [r.verdict for r in got[2]] == ["PERMIT", "ESTOP", "ESTOP"] and not any(r.breach for r in got[2])


def test_latch(spark):
    frames = spark.createDataFrame([(1, f, "a", 5.0 if f == 3 else 0.5) for f in range(6)], "session long, frame_id long, action string, norm double")
    rows = G.decide(frames, spark.createDataFrame([("a", 1.0)], "action string, bound double")).orderBy("frame_id").collect()
    assert [r.verdict for r in rows] == ["PERMIT"] * 3 + ["ESTOP"] * 3
    assert [r.breach for r in rows] == [False, False, False, True, False, False]
    assert G.first_breach(spark.createDataFrame(rows)).first().breach_frame == 3


def test_windows_without_frames(spark):
    """With pre and post 0 a window keeps nothing; with post 0 only what is before the trigger."""
    frames = spark.createDataFrame([(1, f, f == 5) for f in range(10)], "session long, frame_id long, hit boolean")
    triggers = spark.createDataFrame([(1, 5)], "session long, trigger long")
    for pre, post, want in ((0, 0, []), (2, 0, [3, 4]), (0, 1, [5])):
        kept = [lambda df: df.where("kept"), lambda df: df]
        got = [kept[0](W.keep_extending(frames, F.col("hit"), pre, post)), kept[0](W.keep_latched(frames, F.col("hit"), pre, post)), W.keep_by_triggers(frames, triggers, pre, post)]
        assert [sorted(r.frame_id for r in df.collect()) for df in got] == [want] * 3, (pre, post)
        assert sum(r.frames for r in W.trigger_windows(frames, triggers, pre, post).collect()) == len(want)


def test_a_record_without_hash_breaks_the_chain(spark):
    from veristream.operators import verify as V

    rows = spark.createDataFrame([(1, k, None if k == 2 else "ab" * 32) for k in range(4)] + [(2, 0, "cd" * 32)], "session long, n long, h string")
    chain = V.chained(rows, "session", "n", F.col("h"))
    assert {(r.session, r.records, r.first_break) for r in V.chain_breaks(chain).collect()} == {(1, 4, 2), (2, 1, None)}


def test_sessions_are_sealed_and_stay_sealed(spark, tmp_path):
    """An end marker or silence seals a session once; a tombstone stops what comes later, until it is buried."""
    from datetime import datetime, timedelta

    from veristream.plans import streams
    from veristream.streaming import incidents as I

    start = datetime(2024, 1, 1)
    frame = lambda s, f, norm, minutes, ended=None, event=None: (s, f, "a", norm, start + timedelta(minutes=minutes), ended, event)
    batches = [
        [frame(1, 0, 0.5, 0), frame(1, 1, 0.5, 0), frame(1, 2, 9.0, 0, event={"surface": "ice", "evt": "own"}), frame(2, 0, 0.5, 1), frame(3, 0, 0.5, 1, ended=True)],
        [frame(1, 3, 0.5, 2, ended=True), frame(1, 4, 0.5, 2), frame(2, 1, None, 3), frame(3, 1, 0.5, 3)],
        [frame(9, 0, 0.5, 30)],  # the watermark passes the silence of session 2
        [frame(2, 2, 0.5, 31), frame(9, 1, 0.5, 31)],
        [frame(9, 2, 0.5, 31 + 7 * 1440)],  # and the burial of all others
        [frame(1, 0, 0.5, 32 + 7 * 1440)],
    ]
    schema = "session long, frame_id long, action string, norm double, at timestamp, ended boolean, event map<string,string>"
    make = lambda s: I.sessions(s.withWatermark("at", "1 minute"), {"a": 1.0}, "sh1", 2, 3, 10 * 60_000, 86_400_000)
    with I.rocksdb(spark):
        rows = streams.batched_stream(spark, [spark.createDataFrame(b, schema) for b in batches], make).collect()
    said = sorted((r.session, r.frame_id, r.reason, r.verdict) for r in rows if r.kind == "decision" and r.session < 9)
    assert said == [
        (1, 0, "within envelope", "PERMIT"), (1, 0, "within envelope", "PERMIT"), (1, 1, "within envelope", "PERMIT"), (1, 2, "norm exceeds bound", "ESTOP"), (1, 3, "prior breach", "ESTOP"), (1, 4, "session ended", "ESTOP"),
        (2, 0, "within envelope", "PERMIT"), (2, 1, "non-finite norm", "ESTOP"), (2, 2, "session ended", "ESTOP"), (3, 0, "within envelope", "PERMIT"), (3, 1, "session ended", "ESTOP"),
    ]
    incidents = {r.session: r for r in rows if r.kind == "incident"}
    assert {s: (r.frame_id, r.kept_from, r.kept_to, r.frames, r.closed_by) for s, r in incidents.items()} == {1: (2, 0, 4, 4, "end"), 2: (1, 0, 3, 2, "silence")}
    assert incidents[1].event == {"surface": "ice", "evt": "envelope_breach", "action": "a", "l_inf": "9.000000", "bound": "1.000000", "envelope_shard_id": "sh1", "reason": "norm exceeds bound"}
    assert incidents[2].event["l_inf"] == "inf" and len([r for r in rows if r.kind == "incident"]) == 2


@pytest.mark.parametrize("sketch", [10_000, 20])
def test_exact_percentiles(spark, monkeypatch, sketch):
    """Few and many rows, ties, negative values, a null action; in a whole group and in a bracket."""
    import random

    import numpy as np

    from veristream.operators import envelope as E

    monkeypatch.setattr(E, "SKETCH", sketch)
    draw = random.Random(1)
    groups = {"one": [3.0], "two": [1.0, 2.0], None: [draw.gauss(0, 5) for _ in range(700)], "ties": draw.choices([1.0, 2.0, 7.5], k=500), "many": [draw.random() ** 9 for _ in range(3000)]}
    rows = [(k, x) for k, values in groups.items() for x in values] + [("one", float("nan")), ("two", None), ("none", float("inf"))]
    df = spark.createDataFrame(rows, "action string, norm double").repartition(5)
    for p in (0.0, 0.5, 0.99, 1.0):
        got = {r.action: (r.sample_count, r.bound) for r in E.learn(df, p, 1.1).collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert got[k][0] == len(values) and abs(got[k][1] - np.quantile(values, p) * 1.1) < 2e-6, (k, p)
    plan = E.learn(df)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "RDDScan" not in plan


def test_lineage_over_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 1), (1, 2), (4, 7)]
    starts = [1, 5, 6, 8]
    want = set()
    for s in starts:
        seen, frontier, hop = {s}, {s}, 0
        while frontier:
            want |= {(s, n, hop) for n in frontier}
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            hop += 1
    from veristream.operators import graph as H

    got = H.lineage_closure(spark.createDataFrame([(s,) for s in starts], "node long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_training_document_and_its_citations(spark):
    """Places by ranges are those of the text put together; every claim cites its line, and the bytes there are the claimed text."""
    from veristream.operators import manifest as M
    from veristream.operators import verify as V

    capsules = spark.createDataFrame([(f"é{k % 7}-{k}", f"{k:064x}") for k in range(400)], "name string, sha256 string").repartition(5)
    bounds = spark.createDataFrame([("steer", 9, 0.5, 0.55), ("größer", 3, 1e-7, 1.1e-7)], "action string, sample_count long, value double, bound double")
    document = M.placed(M.lines(capsules, bounds, "2024-01-01T00:00:00Z"))
    rows = sorted(document.collect(), key=lambda r: r.byte_start)
    text = "".join(r.line + "\n" for r in rows).encode()
    assert all(text[r.byte_start : r.byte_end].decode() == r.line for r in rows) and rows[-1].byte_end == len(text) - 1
    assert [r.line for r in rows][:8] == ["BOUNDS COMPILER: TRAINING MANIFEST", "=" * 35, "Generated: 2024-01-01T00:00:00Z", "Capsules: 400", "Percentile: 99", "Safety margin: 1.1", "---", f"capsule: é0-0 sha256: {'0' * 64}"]
    assert [r.key for r in rows if r.section == 7] == sorted((f"é{k % 7}-{k}" for k in range(400)), key=str.encode)
    g = M.graph(document, bounds)
    spans = g["provenance"].join(g["spans"].select("span_id", "text"), "span_id").withColumn("content", F.lit(text))
    matched = V.span_matches(spans, F.col("content"), F.col("byte_start"), F.col("byte_end"), F.col("text"))
    assert matched.where("matches").select("claim_id").distinct().count() == g["claims"].count() == 8
    changed = M.placed(M.lines(capsules.where("name <> 'é1-1'"), bounds, "2024-01-01T00:00:00Z"))
    assert M.source_hash(changed).first() != M.source_hash(document).first()


def test_recursive_lineage_has_no_limit_of_rows(spark):
    """More rows than Spark's limit for a recursion, which is a million unless set."""
    from veristream.operators import graph as H

    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "50")
    try:
        starts = spark.range(40).selectExpr("'a' || id AS node")
        edges = starts.selectExpr("node AS src", "'b' AS dst").union(spark.createDataFrame([("b", "c"), ("c", "d")], "src string, dst string"))
        got = H.lineage_recursive(spark, starts, edges).collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted((r.start, r.node, r.hop) for r in got) == sorted((f"a{k}", n, h) for k in range(40) for h, n in enumerate([f"a{k}", "b", "c", "d"]))


def test_lineage_rounds_broadcast_nothing(spark):
    """Whatever the driver would send to all executors it would do anew in each round."""
    from veristream.operators import graph as H

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    edges = spark.range(1, 200).selectExpr("id AS src", "id DIV 3 AS dst")
    assert H.lineage_closure(edges.select(edges.src.alias("node")), edges).count() > 500
    runs = store.executionsList()
    plans = [runs.apply(k).physicalPlanDescription() for k in range(runs.size())][before:]
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_rows_are_judged_as_by_the_guard():
    """One by one and all at once: the same decisions, whatever norms, marks and order there are."""
    import math
    import random

    import pandas as pd
    from pyspark.sql import Row

    from veristream.streaming import guard as S
    from veristream.streaming import incidents as I

    draw, bounds = random.Random(3), {"a": 1.0, "b": float("inf"), "c": float("nan"), "d": None}
    for _ in range(300):
        rows = [Row(frame_id=f, action=draw.choice(["a", "a", "a", "a", "b", "c", "d", "x"]), norm=draw.choice([0.5] * 9 + [2.0, None, math.nan, math.inf, -math.inf]), ended=draw.choice([None] * 9 + [False, True])) for f in sorted(draw.choices(range(12), k=draw.randint(1, 6)))]
        before = draw.choice([False, False, True]), draw.choice([-1, 3]), draw.choice([False, False, False, True])
        want = S.judge(pd.DataFrame([r.asDict() for r in rows]).astype({"norm": float, "ended": object}), bounds, *before)
        blank = lambda x: None if isinstance(x, float) and math.isnan(x) else x
        assert list(I.decide(rows, bounds, *before)) == [tuple(map(blank, r)) for r in want[["verdict", "acted", "norm", "bound", "reason", "breach"]].itertuples(index=False)]


def test_a_batch_reads_and_writes_a_session_once():
    """Each call to the state is a message to the JVM.  A timer that goes off early is moved on."""
    from datetime import datetime, timedelta, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    from veristream.streaming import incidents as I

    calls, values, timers = [], {}, []

    def value(name, schema):
        called = lambda kind, f: lambda *a: (calls.append((name, kind)), f(*a))[1]
        return SimpleNamespace(get=called("get", lambda: values.get(name)), update=called("update", lambda x: values.update({name: x})), clear=called("clear", lambda: values.pop(name, None)), exists=called("exists", lambda: name in values))

    handle = SimpleNamespace(getValueState=value, getListState=value, registerTimer=lambda t: (calls.append("timer"), timers.append(t)), deleteTimer=lambda t: (calls.append("timer"), timers.remove(t)), listTimers=lambda: calls.append("timer") or list(timers))
    sessions = I.Sessions({"a": 1.0}, "sh1", 2, 3, 60_000, 3_600_000)
    sessions.init(handle)
    now = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    ms = int(start.timestamp() * 1000)
    batch = lambda k, norm=0.5, watermark=0: list(sessions.handleInputRows((7,), iter([Row(frame_id=10 * k + f, action="a", norm=norm if f == 5 else 0.5, at=start + timedelta(seconds=30 * k), event=None, ended=None) for f in range(10)]), now(watermark)))
    for k in range(4):
        calls.clear()
        assert [r.verdict for r in batch(k)] == ["PERMIT"] * 10
        assert len(calls) <= (3 if k == 0 else 2), calls
    batch(4, 9.0)
    fired = lambda at, watermark: [timers.remove(at), list(sessions.handleExpiredTimer((7,), now(watermark), SimpleNamespace(getExpiryTimeInMs=lambda: at)))][1]
    assert timers == [ms + 60_000] and fired(ms + 60_000, ms + 60_001) == [] and timers == [ms + 180_000]
    sealed = fired(ms + 180_000, ms + 180_001)
    assert [(r.kind, r.frame_id, r.kept_from, r.kept_to, r.frames, r.closed_by) for r in sealed] == [("incident", 45, 43, 47, 50, "silence")]
    assert [r.reason for r in batch(5, watermark=ms + 180_001)] == ["session ended"] * 10 and timers == [ms + 3_780_000]
    assert fired(timers[0], ms + 9_000_000) == [] and not timers and not values

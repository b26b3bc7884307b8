"""Capsules recorded, compiled, tampered with, trained on and flown."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veristream.plans import flows
from veristream.sources import generate


@pytest.fixture(scope="module")
def capsules(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("capsules"))
    missions = generate.missions(spark, 2, 60, seed=7, fault_at=25, residual_bytes=128)
    summary = flows.record(spark, folder, missions, pre=5, post=6).collect()
    assert {(r.observed, r.kept, r.triggers, r.triggered) for r in summary} == {(60, 11, 1, True)}
    return folder


def test_graph(spark, capsules):
    tables = flows.graph_tables(spark, capsules)
    claims = {(r.subject, r.predicate, r.object) for r in tables["claims"].collect()}
    assert ("robot-001", "observed", "wheel_slip") in claims and ("wheel_slip", "on_surface", "ice") in claims
    lines = open(f"{capsules}/mission-0/events.jsonl", "rb").read()
    want = {(a, c) for line in lines.splitlines() for a, c in json.loads(line)["action_distribution"].items()}
    said = {tuple(json.loads(o).values()) for _, p, o in claims if p == "considered_action"}
    assert want <= said
    source = hashlib.sha256(lines).hexdigest()
    spans = tables["spans"].where(F.col("source_hash") == source).collect()
    assert spans and all(lines[r.byte_start : r.byte_end].decode() == r.text for r in spans)
    proven = tables["provenance"].join(tables["spans"], "span_id").join(tables["claims"], "claim_id")
    assert proven.count() == tables["provenance"].count() and tables["claims"].join(tables["provenance"], "claim_id", "left_anti").count() == 0


def test_graph_tables_are_whole(spark, tmp_path):
    (tmp_path / "c" / "run").mkdir(parents=True)
    base = {"frame_id": 0, "robot_id": "r1", "stream_refs": {"latents": {"file": "cam_latents.bin", "offset": 4, "length": 269}}}
    log = [{**base, "evt": "wheel_slip", "surface": "ice"}, {**base, "frame_id": 1, "evt": "envelope_breach", "action": "a", "l_inf": "inf", "bound": "none", "envelope_shard_id": "sh1_law"}]
    (tmp_path / "c" / "run" / "events.jsonl").write_text("".join(json.dumps(e) + "\n" for e in log))
    tables = flows.graph_tables(spark, str(tmp_path / "c"))
    claims = {r.claim_id: r for r in tables["claims"].collect()}
    assert {(r.label, r.namespace, r.type) for r in tables["entities"].collect()} == {(x, flows.NAMESPACE, "entity") for x in ("r1", "wheel_slip")}
    cited = tables["references"].collect()
    assert [(claims[r.claim_id].predicate, r.dst_shard_id, r.relation_type, r.dst_object_type) for r in cited] == [("breached_envelope", "sh1_law", "cites", "shard")]
    assert {(r.frame_id, r.status) for r in tables["streams"].collect()} == {(0, "EOF"), (1, "OFFSET_MISMATCH")}
    for name in ("one", "two"):
        flows.write_tables(tables, str(tmp_path / name))
    read = lambda name, t: spark.read.parquet(str(tmp_path / name / t)).collect()
    assert all(read("one", t) == read("two", t) for t in tables) and len(read("one", "claims")) == len(claims)
    with pytest.raises(Exception, match="no claims"):
        flows.write_tables({"claims": tables["claims"].where("false")}, str(tmp_path / "none"))


def test_nothing_to_learn_from_is_refused(spark):
    from veristream.operators import envelope as E
    from veristream.operators import govern as G

    none = spark.createDataFrame([("a", float("nan"))], "action string, norm double")
    with pytest.raises(Exception, match="no frames"):
        E.require_rows(E.learn(none), "frames").collect()
    some = spark.createDataFrame([("a", float(k)) for k in range(5)], "action string, norm double")
    assert [tuple(r) for r in E.require_rows(E.learn(some, 0.5, 1.0), "frames").collect()] == [("a", 5, 2.0)]
    plan = E.require_rows(spark.range(10).repartition(3), "rows")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and E.require_rows(spark.range(10), "rows").count() == 10
    shards = spark.createDataFrame([("s", "key", True, True, None), ("t", "key", None, True, 0), ("u", "key", True, None, 0), ("v", "key", True, True, 1)], "shard_id string, publisher string, has_key boolean, verified boolean, tier int")
    store = spark.createDataFrame([("key",)], "fingerprint string")
    policy = lambda *rows: G.policy_tier(spark.createDataFrame(list(rows), "max_actuation_tier int"))
    assert (policy(), policy((None,)), policy((1,))) == (0, 0, 1)
    got = {r.shard_id: r.reason for r in G.authorise(shards, store, policy((1,))).collect()}
    assert got == {"s": "no claims", "t": "no publisher key", "u": "verification failed", "v": "granted"}


def test_index_and_tampering(spark, capsules, tmp_path):
    import shutil

    index = flows.stream_index(spark, capsules, strict=True)
    assert {(r.stream, r.status): r["count"] for r in index.groupBy("stream", "status").count().collect()} == {("latents", "VERIFIED"): 120, ("residuals", "VERIFIED"): 22}
    shutil.copytree(capsules, tmp_path / "c")
    path = tmp_path / "c" / "mission-1" / "cam_latents.bin"
    data = path.read_bytes()
    path.write_bytes(data[: 4 + 10 * 269] + data[4 + 11 * 269 :])  # one record cut out
    found = {r.status: r["count"] for r in flows.stream_index(spark, str(tmp_path / "c")).where("session = 'mission-1' AND stream = 'latents'").groupBy("status").count().collect()}
    assert found == {"VERIFIED": 10, "DRIFT": 49, "EOF": 1}
    with pytest.raises(Exception, match="verification failed"):
        flows.stream_index(spark, str(tmp_path / "c"), strict=True).collect()


@pytest.mark.parametrize("at, value, status", [(4, b"\x02", "BAD_VERSION"), (9, b"\xff\xff\xff\x7f", "TOO_LARGE"), (0, b"X", None)])
def test_fatal_cold_records(spark, capsules, tmp_path, at, value, status):
    """Strict mode fails on a wrong version or size in the cold stream, not on damage that the scan passes over."""
    import shutil

    shutil.copytree(capsules, tmp_path / "c")
    path = tmp_path / "c" / "mission-1" / "cam_residuals.bin"
    data = path.read_bytes()
    path.write_bytes(data[:at] + value + data[at + len(value) :])
    assert flows.stream_index(spark, str(tmp_path / "c")).where("stream = 'residuals'").count() < 22
    if status:
        with pytest.raises(Exception, match=f"verification failed: {status}"):
            flows.stream_index(spark, str(tmp_path / "c"), strict=True).collect()
    else:
        assert flows.stream_index(spark, str(tmp_path / "c"), strict=True).count() > 120


def test_train_and_fly(spark, capsules, tmp_path):
    flows.record(spark, str(tmp_path), generate.missions(spark, 3, 80, seed=100, residual_bytes=16))
    envelope = flows.train(spark, str(tmp_path))
    assert {r.action: r.sample_count for r in envelope.collect()} == dict.fromkeys(generate.SAFE, 60)
    summaries = [json.loads(p.read_text()) for p in sorted(tmp_path.rglob("session.json"))]
    assert [(s["session_id"], s["robot_id"], s["frames"], s["triggered"]) for s in summaries] == [(f"mission-{k}", "robot-001", 80, False) for k in range(3)]
    shard = spark.createDataFrame([("sh1", "key", True, True, 0)], "shard_id string, publisher string, has_key boolean, verified boolean, tier int")
    store = spark.createDataFrame([("key",)], "fingerprint string")
    flight = flows.capsule_frames(spark, capsules)
    decisions, incidents = flows.fly(flight, envelope, shard, store)
    assert {(r.session, r.breach_frame, r.cites) for r in incidents.collect()} == {("mission-0", 25, "sh1"), ("mission-1", 25, "sh1")}
    assert decisions.where("verdict = 'PERMIT'").count() == 50
    refused, _ = flows.fly(flight, envelope, shard, store.where("false"))
    assert {r.reason for r in refused.where("frame_id = 0").collect()} == {"no bound"}
    # A capsule without its stream isn't learned from.
    (tmp_path / "mission-2" / "cam_latents.bin").unlink()
    assert {r.sample_count for r in flows.train(spark, str(tmp_path)).collect()} == {40}


def test_trusted_keys(spark, tmp_path):
    (tmp_path / "a.pub").write_bytes(b"one")
    (tmp_path / "b.pub").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"one")
    store = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(),)], "fingerprint string")
    assert [r.path.rsplit("/", 1)[1] for r in flows.trusted_keys(spark, str(tmp_path), store).collect()] == ["a.pub"]


def test_captures_are_judged_with_their_log(spark, tmp_path):
    frames = spark.createDataFrame([(s, k, f"{s} frame {k}".encode(), k in (15, 18)) for s in ("a", "b") for k in range(30)], "session string, frame_id long, payload binary, trigger boolean")
    summary = flows.capture(spark, str(tmp_path), frames, pre=5, post=5).collect()
    assert {(r.session, r.observed, r.kept, r.triggers) for r in summary} == {("a", 30, 13, 2), ("b", 30, 13, 2)}

    def found():
        return {(r.session, r.frame_id, r.finding) for r in flows.capture_findings(spark, str(tmp_path)).where("finding <> 'VERIFIED'").collect()}

    assert found() == set() and flows.capture_findings(spark, str(tmp_path)).count() == 26
    disk, log = tmp_path / "a" / "frames.bin", tmp_path / "a" / "events.jsonl"
    data, lines = disk.read_bytes(), log.read_text().splitlines()
    # A payload's byte.
    at = data.index(b"a frame 12")
    disk.write_bytes(data[:at] + b"A" + data[at + 1 :])
    assert ("a", 12, "HASH_MISMATCH") in found()
    # A record cut out.
    first = data.index(b"AXFR", data.index(b"a frame 11"))
    after = data.index(b"AXFR", first + 4)
    disk.write_bytes(data[:first] + data[after:])
    bad = found()
    assert {("a", 13, "CHAIN_BROKEN"), ("a", 12, "claimed, not on disk"), ("a", 14, "reference mismatch")} <= bad
    # A record twice.
    disk.write_bytes(data[:after] + data[first:])
    assert ("a", 12, "NOT_INCREASING") in found()
    disk.write_bytes(data)
    # A log that lies, and one that is silent.
    event = json.loads(lines[3])
    for change, finding in (({"content_sha256": "0" * 64}, "hash mismatch"), ({"chain": "0" * 64}, "chain mismatch"), ({"stream_refs": {"frames": {"offset": 4, "length": 9}}}, "reference mismatch")):
        log.write_text("\n".join([*lines[:3], json.dumps(event | change), *lines[4:]]) + "\n")
        assert found() == {("a", 13, finding)}
    log.write_text("\n".join(lines[1:]) + "\n")
    assert found() == {("a", 10, "on disk, not claimed")}
    with pytest.raises(Exception, match="on disk, not claimed"):
        from veristream.operators import verify as V

        V.require(flows.capture_findings(spark, str(tmp_path)), "finding").collect()


def test_captures_become_graphs(spark, tmp_path):
    """Claims cite the log's bytes; a damaged capture gives no graph."""
    frames = spark.createDataFrame([(s, k, f"{s} frame {k}".encode(), k in (5, 18)) for s in ("a", "b") for k in range(30)], "session string, frame_id long, payload binary, trigger boolean")
    flows.capture(spark, str(tmp_path), frames, pre=2, post=3)
    tables = {name: t.collect() for name, t in flows.capture_tables(spark, str(tmp_path)).items()}
    count = {p: sum(c.predicate == p for c in tables["claims"]) for p in {c.predicate for c in tables["claims"]}}
    # The captures' sensors have no name, so their triggers and windows are the same claims, with two lines of evidence each.
    assert count == {"content_sha256": 20, "declared_trigger": 1, "trigger_source": 2, "closed_capture_window": 2}
    assert len(tables["streams"]) == 20 and {r.status for r in tables["streams"]} == {"VERIFIED"}
    logs = {hashlib.sha256(p.read_bytes()).hexdigest(): p.read_bytes() for p in tmp_path.rglob("events.jsonl")}
    assert len(logs) == 2 and all(logs[s.source_hash][s.byte_start : s.byte_end].decode() == s.text for s in tables["spans"])
    spans, claims = {s.span_id for s in tables["spans"]}, {c.claim_id for c in tables["claims"]}
    assert {p.span_id for p in tables["provenance"]} == spans and {p.claim_id for p in tables["provenance"]} == claims
    path = tmp_path / "a" / "frames.bin"
    data = path.read_bytes()
    path.write_bytes(data.replace(b"a frame 6", b"A frame 6"))
    with pytest.raises(Exception, match="verification failed"):
        flows.capture_tables(spark, str(tmp_path))

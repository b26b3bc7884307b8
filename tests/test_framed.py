"""Binary files written, damaged and read again."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import verify as V
from veristream.sources import framed, generate


@pytest.fixture
def hot(spark, tmp_path):
    framed.register(spark)
    missions = generate.missions(spark, 2, 30, fault_at=20, residual_bytes=64)
    framed.write_hot(missions.select("session", "frame_id", F.col("latents").alias("payload")), str(tmp_path)).collect()
    return tmp_path


def read(spark, path, kind):
    return spark.read.format("framed").option("kind", kind).load(str(path))


def test_round_trip(spark, hot):
    rows = read(spark, hot, "hot").collect()
    assert len(rows) == 60 and {r.status for r in rows} == {"VERIFIED"}
    want = {(r.session, r.frame_id): bytes(r.latents) for r in generate.missions(spark, 2, 30, fault_at=20, residual_bytes=64).collect()}
    assert all(bytes(r.payload) == want[r.session, r.frame_id] for r in rows)
    assert (hot / "mission-0" / "cam_latents.bin").stat().st_size == 4 + 30 * 269


def test_filter_seeks(spark, hot):
    one = read(spark, hot, "hot").where("frame_id = 7")
    assert [r.offset for r in one.collect()] == [4 + 7 * 269] * 2


@pytest.mark.parametrize("at, status", [(4, "BAD_MAGIC"), (8, "BAD_VERSION"), (9, "DRIFT"), (13, "BAD_DIM")])
def test_damage_in_a_header(spark, hot, at, status):
    path = hot / "mission-0" / "cam_latents.bin"
    data = bytearray(path.read_bytes())
    data[at + 5 * 269] ^= 0x40
    path.write_bytes(data)
    bad = read(spark, path, "hot").where("status <> 'VERIFIED'").collect()
    assert [r.status for r in bad] == [status] and bad[0].offset == 4 + 5 * 269


def test_torn_excised_and_strict(spark, hot):
    path = hot / "mission-0" / "cam_latents.bin"
    data = path.read_bytes()
    path.write_bytes(data[:-10])
    assert [r.status for r in read(spark, path, "hot").where("status <> 'VERIFIED'").collect()] == ["TORN_WRITE"]
    path.write_bytes(data[: 4 + 3 * 269] + data[4 + 4 * 269 :])
    rows = read(spark, path, "hot")
    assert rows.where("status = 'DRIFT'").count() == 26
    with pytest.raises(Exception, match="verification failed: DRIFT"):
        V.require(rows).collect()
    path.write_bytes(b"XXXX" + data[4:])
    assert [r.status for r in read(spark, path, "hot").collect()] == ["BAD_FILE_HEADER"]


def test_cold_resynchronises(spark, tmp_path):
    framed.register(spark)
    rows = [("s", k, bytes([65 + k]) * (20 + k)) for k in range(5)]
    framed.write_cold(spark.createDataFrame(rows, "session string, frame_id long, payload binary"), str(tmp_path)).collect()
    path = tmp_path / "s" / "cam_residuals.bin"
    data = bytearray(path.read_bytes())
    second = 13 + 20
    data[second] = 0
    path.write_bytes(data + b"AX")
    found = read(spark, path, "cold").orderBy("offset").collect()
    assert [r.status for r in found] == ["VERIFIED", "RESYNC", "VERIFIED", "VERIFIED", "VERIFIED", "TRUNCATED_HEADER"]
    assert found[1].garbage == 13 + 21
    assert framed.scan_stats(read(spark, path, "cold")).first().asDict() == {"records": 4, "corrupt_headers": 1, "resyncs": 1, "garbage_bytes": 34}
    big = struct.pack("<4sBII", b"AXRR", 1, 9, 11 << 20)
    path.write_bytes(big)
    assert [r.status for r in read(spark, path, "cold").collect()] == ["TOO_LARGE"]


def test_frames_chain(spark, tmp_path):
    framed.register(spark)
    rows = [("s", k, f"frame {k}".encode()) for k in (3, 4, 7)]
    framed.write_frames(spark.createDataFrame(rows, "session string, frame_id long, payload binary"), str(tmp_path)).collect()
    found = read(spark, tmp_path, "frames")
    assert V.chain_breaks(found).first().first_break is None
    assert V.chain_breaks(found.where("frame_id <> 4")).first().first_break == 7
    path = tmp_path / "s" / "frames.bin"
    data = bytearray(path.read_bytes())
    data[-1] ^= 1
    path.write_bytes(data)
    assert [r.status for r in read(spark, path, "frames").orderBy("offset").collect()] == ["VERIFIED", "VERIFIED", "HASH_MISMATCH"]


def test_writes_as_a_data_source(spark, tmp_path):
    framed.register(spark)
    rows = [(f"s{k % 3}", k // 3, f"payload {k}".encode()) for k in range(12)]
    df = spark.createDataFrame(rows, "session string, frame_id long, payload binary")
    sorted_ = df.repartition("session").sortWithinPartitions("session", "frame_id")
    save = lambda rows, mode, kind="frames", **options: rows.write.format("framed").option("kind", kind).options(**options).mode(mode).save(str(tmp_path / "one"))
    save(sorted_, "append")
    framed.write_frames(df, str(tmp_path / "two")).collect()
    for k in range(3):
        assert (tmp_path / "one" / f"s{k}" / "frames.bin").read_bytes() == (tmp_path / "two" / f"s{k}" / "frames.bin").read_bytes()
    assert {r.status for r in V.judge_frames(read(spark, tmp_path / "one", "frames")).collect()} == {"VERIFIED"}
    with pytest.raises(Exception, match="sessions that have a file"):
        save(sorted_, "append")
    with pytest.raises(Exception, match="stand apart"):
        save(df.repartition(4).sortWithinPartitions("session", "frame_id"), "overwrite", "cold")
    # A record that can't be written: the whole job leaves nothing.
    with pytest.raises(Exception, match="hot records"):
        save(sorted_, "append", "hot")
    assert sorted(p.name for p in (tmp_path / "one").rglob("*") if p.is_file()) == ["frames.bin"] * 3
    save(sorted_, "overwrite", domain="other@1:")
    assert {r.status for r in V.judge_frames(read(spark, tmp_path / "one", "frames"), "other@1:").collect()} == {"VERIFIED"}
    # Other sessions' files go; other kinds stay.
    save(sorted_, "append", "cold")
    save(sorted_.where("session = 's1'").withColumn("session", F.lit("new")), "overwrite")
    assert {r.session for r in read(spark, tmp_path / "one", "frames").collect()} == {"new"} and read(spark, tmp_path / "one", "cold").count() == 12


def test_logs_and_tables(spark, tmp_path):
    events = spark.createDataFrame([("s", 1, '{"frame_id": 1, "a": 1}', '{"a": 2}'), ("s", 0, '{"frame_id": 0}', None)], "session string, frame_id long, base string, extra string")
    framed.write_event_log(events, str(tmp_path)).collect()
    log = framed.event_log(spark, f"{tmp_path}/s/events.jsonl")
    assert [(r.session, r.line) for r in log.collect()] == [("s", '{"frame_id": 0}'), ("s", '{"frame_id": 1, "a": 2}')]
    assert framed.json_table(spark, f"{tmp_path}/none.jsonl", "a long").count() == 0
    assert framed.json_table(spark, f"{tmp_path}/s/events.jsonl", "frame_id long, a long").count() == 2
    other = spark.createDataFrame([("t",), ("s",)], "session string")
    assert [r.session for r in framed.discover(other, log).collect()] == ["s"]


def test_expressions(spark):
    ids = [("s", "0", "5", "é"), ("", "", "", "")]
    df = spark.createDataFrame(ids, "a string, b string, c string, d string")
    import base64

    for row, got in zip(ids, df.coalesce(1).select(X.deterministic_id("s_", *map(F.col, "abcd"))).collect(), strict=True):
        assert got[0] == "s_" + base64.b32encode(hashlib.sha256("\0".join(row).encode()).digest()[:15]).decode().lower().rstrip("=")
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([([],), ([1.0, -3.0],), ([nan, 1.0],), ([-inf],), ([0.1, None],), (None,)], "v array<float>")
    assert [r[0] for r in v.coalesce(1).select(X.linf(F.col("v"))).collect()] == [inf, 3.0, inf, inf, inf, inf]
    n = spark.range(1).select(X.le32(F.lit(258)).alias("b"))
    assert n.first().b == b"\x02\x01\0\0" and n.select(X.from_le32(F.col("b")).alias("n")).first().n == 258
    assert len(spark.range(1).select(X.timestamp_query(F.lit("ab" * 32)).alias("q")).first().q) == 59


@pytest.mark.parametrize("kind", ["cold", "frames"])
def test_split_scans_give_the_rows_of_the_walk(spark, tmp_path, kind):
    """Files whole and damaged, with payloads that hold headers, at splits far smaller and larger than a record."""
    import random
    import struct

    framed.register(spark)
    draw = random.Random(5)
    magic = framed.KINDS[kind][2]
    false = struct.pack(framed.HEADER, magic, 1, 7, 5) + b"12345"
    rows = [(f"s{s}", k, draw.choice([b"", false, false * 3, magic, draw.randbytes(draw.randrange(200))])) for s in range(6) for k in range(30)]
    df = spark.createDataFrame(rows, "session string, frame_id long, payload binary")
    (framed.write_cold if kind == "cold" else framed.write_frames)(df, str(tmp_path)).collect()
    name = framed.KINDS[kind][0]
    for s in range(1, 6):
        path = tmp_path / f"s{s}" / name
        data = bytearray(path.read_bytes())
        at = draw.randrange(len(data) // 3, len(data) - 20)
        damaged = {1: data[:at] + b"damage" + data[at + 9 :], 2: data[:at], 3: data[: data.index(magic, at)] + magic + b"\x09" + data[at:], 4: b"XX" + data[2:], 5: data[:7]}[s]
        path.write_bytes(bytes(damaged))
    key = lambda rows: sorted(map(str, rows))
    want = key(read(spark, tmp_path, kind).collect())
    assert len({r.status for r in read(spark, tmp_path, kind).collect()}) > 2
    for size in (50, 333, 5000, 1 << 20):
        got = framed.scan(spark, kind, str(tmp_path), size)
        assert key(got.collect()) == want, size
        assert size > 333 or got.rdd.getNumPartitions() > 12
    assert framed.scan(spark, kind, str(tmp_path / "none")).count() == 0


def test_queue_repeats_and_orders(spark, tmp_path):
    """A repeated batch or flush changes nothing, nor does the order in which they are written; ANCHORED is for good."""
    from veristream.streaming import queue as Q

    def sealed(*names):
        return Q.entries(spark.createDataFrame([(n, "key", None, None, None) for n in names], "manifest string, publisher_id string, created_at string, queued_at string, note string"))

    def said(good, *names):
        blob = b"\x18\x0f20240102030405Z" if good else b"\x18\x0fno"
        return spark.createDataFrame([("sh1_" + hashlib.sha256(n.encode()).hexdigest(), "tsa", blob) for n in names], "shard_id string, authority string, response binary")

    q = Q.Queue(spark, str(tmp_path / "q"))
    assert q.listing().count() == 0 and q.flush(said(True, "a"), 0).count() == 0
    q.put(sealed("a", "b", "a", None), 0)
    state = lambda: {r.shard_id[4:8]: (r.state, r.attempts, r.anchored_at, r.error) for r in q.listing().collect()}
    a, b, c = (hashlib.sha256(n).hexdigest()[:4] for n in (b"a", b"b", b"c"))
    q.flush(said(True, "a"), 1)
    assert state() == {a: ("ANCHORED", 1, "2024-01-02T03:04:05Z", None), b: ("PENDING", 1, None, "no response")}
    before = state()
    q.put(sealed("a", "b", "a", None), 0)
    q.flush(said(True, "a"), 1)
    q.put(sealed("a"), 1)
    assert state() == before
    q.put(sealed("c"), 2)
    q.flush(said(False, "a", "b", "c"), 2)
    assert state() == {a: before[a], b: ("PENDING", 2, None, "response without time"), c: ("PENDING", 1, None, "response without time")}
    assert [len(r.query) for r in q.listing().collect()] == [59] * 3 and all(json.loads(r.record)["publisher_id"] == "key" for r in q.listing().collect())


@pytest.mark.parametrize("kind", ["cold", "frames"])
def test_points_are_read_where_they_are(spark, tmp_path, kind):
    """Each record of a scan at its offset, whatever is damaged elsewhere; other places are judged by themselves."""
    framed.register(spark)
    rows = [(f"s{s}", k, bytes([k]) * (k * 7 % 50)) for s in range(3) for k in range(20)]
    (framed.write_cold if kind == "cold" else framed.write_frames)(spark.createDataFrame(rows, "session string, frame_id long, payload binary"), str(tmp_path)).collect()
    whole = framed.scan(spark, kind, str(tmp_path)).collect()
    path = tmp_path / "s1" / framed.KINDS[kind][0]
    data = path.read_bytes()
    path.write_bytes(data[:5] + b"\xff" + data[6:-1])
    wanted = spark.createDataFrame([(r.session, r.offset) for r in whole] * 2 + [("s0", 1), ("s0", 10**6), ("s2", len(data) - 3), ("none", 0), (None, 4), ("s0", -1)], "session string, offset long")
    got = {(r.session, r.offset): r for r in framed.points(spark, kind, str(tmp_path), wanted, 200).collect()}
    last = max(r.offset for r in whole if r.session == "s1")
    assert all(got[r.session, r.offset] == r for r in whole if r.session != "s1" or 20 < r.offset < last)
    assert {k: r.status for k, r in got.items() if k not in {(r.session, r.offset) for r in whole}} == {("s0", 1): "BAD_MAGIC", ("s0", 10**6): "EOF", ("s2", len(data) - 3): "TRUNCATED_HEADER", ("none", 0): "EOF"}
    assert got["s1", last].status == "TORN_WRITE"


def test_a_scan_of_many_bytes_has_no_more_tasks(spark, tmp_path):
    """Ranges grow with the files, so tasks and driver rows don't; the rows are those of the walk."""
    framed.register(spark)
    rows = [(f"s{k % 3}", k // 3, bytes([k % 256]) * (k % 50)) for k in range(6000)]
    framed.write_cold(spark.createDataFrame(rows, "session string, frame_id long, payload binary"), str(tmp_path)).collect()
    columns = ["session", "offset", "frame_id", "dlen", "payload_sha256", "status"]
    found = framed.scan(spark, "cold", str(tmp_path), 200)
    assert found.rdd.getNumPartitions() <= framed.MOST_RANGES + 3
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, read(spark, tmp_path, "cold").select(*columns).collect()))

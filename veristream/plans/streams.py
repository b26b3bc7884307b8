"""Generated missions, binary files and back, and streams that give the rows of their batch queries."""

import uuid
from datetime import timedelta
from itertools import pairwise

from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import envelope as E
from veristream.operators import verify as V
from veristream.operators import windows as W
from veristream.operators.shared import shared_folder
from veristream.sources import framed, generate
from veristream.streaming import guard as S
from veristream.streaming import incidents as I
from veristream.streaming import queue as Q

from . import evidence, telemetry
from .catalog import query, table


@query("decision_literals")
def decision_literals(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.decision_literal(F.col("event_type"), F.round(F.col("value") / 1000, 6)).alias("literal"))


@query("mission_generator")
def mission_generator(spark, d):
    frames = generate.vectors(generate.missions(spark, 3, 50, fault_at=25, residual_bytes=1024), "latents")
    return frames.select("session", "frame_id", "action", X.linf(F.col("vector")).alias("norm"), F.size("distribution").alias("considered"), F.octet_length("residual").alias("residual_bytes"), "evt")


@query("mission_envelope")
def mission_envelope(spark, d):
    """Training missions to an envelope: generator, vectors, norms, percentile."""
    frames = generate.vectors(generate.missions(spark, 3, 100, seed=100), "latents")
    return E.learn(frames.select("action", X.linf(F.col("vector")).alias("norm")))


@query("framed_roundtrip", """WITH f AS (SELECT label::varchar AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_id, embedding[1:64] AS v FROM embeddings)
SELECT session, frame_id, 4 + frame_id * 269 AS "offset", 'VERIFIED' AS status, true AS in_place, list_max(list_transform(v, lambda x: abs(x::double))) AS norm FROM f""")
def framed_roundtrip(spark, d):
    """All embeddings written as hot files, a session for each label, and read again through the data source.  The files go to the
    session's shared folder."""
    framed.register(spark)
    folder = f"{shared_folder(spark).removeprefix('file://')}/framed-{uuid.uuid4().hex}"
    frames = W.numbered(table(spark, d, "embeddings").withColumn("name", F.col("label").cast("string")), "name", "vec_id")
    framed.write_hot(generate.payloads(frames, "embedding").select("session", "frame_id", "payload"), folder).collect()  # one row for each session: the write has to be over before the scan
    records = generate.vectors(spark.read.format("framed").option("kind", "hot").load(folder))
    in_place = F.col("offset") == V.record_offset(F.col("frame_id"))
    return records.select("session", "frame_id", "offset", "status", in_place.alias("in_place"), X.linf(F.col("vector")).alias("norm"))


#: Milliseconds.
DAY = 86_400_000


@query("framed_split_scan", """WITH f AS (SELECT source AS session, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frame_id, encode(coalesce(text, '')) AS p FROM documents WHERE source IS NOT NULL)
SELECT session, frame_id, coalesce(sum(octet_length(p) + 13) OVER (PARTITION BY session ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset", octet_length(p) AS dlen, sha256(p) AS payload_sha256, 'VERIFIED' AS status FROM f""")
def framed_split_scan(spark, d):
    """Documents as records of cold files, one file a source, scanned by several tasks a file."""
    folder = f"{shared_folder(spark).removeprefix('file://')}/framed-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    frames = W.numbered(docs, "source", "doc_id").select("session", "frame_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    framed.write_cold(frames, folder).collect()  # one row for each session: the write has to be over before the scan
    return framed.scan(spark, "cold", folder, 1 << 16).select("session", "frame_id", "offset", "dlen", "payload_sha256", "status")


@query("residual_norms_by_offset", """WITH f AS (SELECT label::varchar AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_id, 256 + vec_id % 4 AS n, embedding[1:64] AS v FROM embeddings)
SELECT session, frame_id, coalesce(sum(n + 13) OVER (PARTITION BY session ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset", n AS dlen, list_max(list_transform(v, lambda x: abs(x::double))) AS norm FROM f""")
def residual_norms_by_offset(spark, d):
    """Embeddings as residuals of uneven length: each read at the offset that its log claims, cut to whole lanes."""
    folder = f"{shared_folder(spark).removeprefix('file://')}/framed-{uuid.uuid4().hex}"
    named = W.numbered(table(spark, d, "embeddings").withColumn("name", F.col("label").cast("string")), "name", "vec_id")
    odd = F.substring(F.unhex(F.lit("FFFFFF")), F.lit(1), (F.col("vec_id") % 4).cast("int"))
    frames = generate.payloads(named, "embedding").withColumn("payload", F.concat("payload", odd))
    framed.write_cold(frames.select("session", "frame_id", "payload"), folder).collect()  # one row for each session
    claimed = V.running_offsets(frames, "session", "frame_id", F.octet_length("payload") + framed.HEADER_BYTES)
    records = generate.vectors(framed.points(spark, "cold", folder, claimed.select("session", "offset")))
    return records.select("session", "frame_id", "offset", "dlen", X.linf(F.col("vector")).alias("norm"))


def ended_stream(spark, rows, make):
    """``make(stream)`` over rows as a stream that ends; its output is a table in the session's
    shared folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/frames")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/frames")
    make(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("streaming_guard", f"{telemetry.D} SELECT * FROM decided")
def streaming_guard(spark, d):
    """The guard over events as a stream; the same rows as ``guard_decisions``."""
    envelope, flown = telemetry.flight(spark, d)
    bounds = {r.action: r.bound for r in envelope.collect()}  # one number for each action
    return ended_stream(spark, flown, lambda s: S.guard(s, bounds))


@query("streaming_guard_null_norms", telemetry.NULL_NORMS)
def streaming_guard_null_norms(spark, d):
    """The same rows as ``guard_null_norms``: a stream fails closed as a batch does."""
    envelope, flown = telemetry.odd_flight(spark, d)
    bounds = {r.action: r.bound for r in envelope.collect()}  # one number for each action
    return ended_stream(spark, flown, lambda s: S.guard(s, bounds)).drop("norm")


def batched_stream(spark, batches, make):
    """``make(stream)`` over several DataFrames, each a batch of its own: after each the stream stops, and goes on from its checkpoint."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for rows in batches:
        rows.write.mode("append").parquet(f"{at}/frames")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/frames")
        make(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


#: Frames of odd sessions: the last one ends its session, but for every fifth session, which falls silent; every third session
#: sends one more frame a day after all others.
SEALED = f"""WITH {telemetry.FRAMES}, {telemetry.ENV}, {telemetry.ODD}, {telemetry.DECIDED.format(env="env").replace("FROM frames f", "FROM odd f")},
z AS (SELECT session, count(*) AS frames, max(frame_id) AS last, session % 5 <> 0 AS marked, session % 3 = 1 AS more FROM decided GROUP BY session),
b AS (SELECT session, min(frame_id) AS breach FROM decided WHERE breach GROUP BY session),
e AS (SELECT d.session, d.frame_id, d.reason, d.norm, d.bound, o.props, z.frames, marked, more FROM decided d JOIN odd o USING (session, frame_id) JOIN z USING (session) WHERE breach),
r AS (SELECT session, 'decision' AS kind, frame_id, verdict, reason, breach FROM decided
  UNION ALL SELECT session, 'decision', last + 1, CASE WHEN marked OR breach IS NOT NULL THEN 'ESTOP' ELSE 'PERMIT' END, CASE WHEN marked THEN 'session ended' WHEN breach IS NOT NULL THEN 'prior breach' ELSE 'within envelope' END, false FROM z LEFT JOIN b USING (session) WHERE more)
SELECT kind, session, frame_id, verdict, reason, breach, NULL AS l_inf, NULL AS limit_, NULL AS k, NULL AS cites, NULL AS kept_from, NULL AS kept_to, NULL AS frames, NULL AS closed_by FROM r
UNION ALL SELECT 'incident', session, frame_id, 'ESTOP', reason, true, CASE WHEN norm IS NULL OR NOT isfinite(norm) THEN 'inf' ELSE printf('%.6f', round(norm, 6)) END, CASE WHEN bound IS NULL THEN 'none' ELSE printf('%.6f', bound) END,
 props->>'$.k', 'sh1_law', greatest(frame_id - {telemetry.PRE}, 0), frame_id + {telemetry.POST - 1}, frames + CASE WHEN more AND NOT marked THEN 1 ELSE 0 END, CASE WHEN marked THEN 'end' ELSE 'silence' END FROM e"""


@query("streaming_incidents", SEALED)
def streaming_incidents(spark, d):
    """Decisions and sealed incidents over six batches, each started anew from the checkpoint; late frames stay stopped."""
    envelope, _ = telemetry.flight(spark, d)
    bounds = {r.action: r.bound for r in envelope.collect()}  # one number for each action
    flown = telemetry.odd_flight(spark, d, "props", F.col("ts").cast("timestamp").alias("at"))[1]
    own = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("reason"), F.lit("the frame's own"))
    last = flown.groupBy("session").agg(F.max("frame_id").alias("last"))
    ends = (F.col("frame_id") == F.col("last")) & (F.col("session") % 5 != 0)
    flown = flown.join(last, "session").select("session", "frame_id", "action", "norm", "at", own.alias("event"), ends.alias("ended"))
    # Numbered once, not anew for each batch.
    at = f"{shared_folder(spark)}/flown-{uuid.uuid4().hex}"
    flown.write.parquet(at)
    flown = spark.read.schema(flown.schema).parquet(at)
    last = flown.groupBy("session").agg(F.max("frame_id").alias("last"))
    begin, end = flown.agg(F.min("at"), F.max("at")).first()
    cuts = [begin + (end - begin) * k / 4 for k in range(4)] + [end + timedelta(seconds=1)]
    batches = [flown.where((F.col("at") >= a) & (F.col("at") < b)) for a, b in pairwise(cuts)]
    sent = lambda rows, frame, at: rows.select("session", frame.alias("frame_id"), F.lit("view").alias("action"), F.lit(0.0).alias("norm"), F.lit(at).alias("at"), F.lit(None).cast("map<string,string>").alias("event"), F.lit(None).cast("boolean").alias("ended"))
    batches.append(sent(last.where("session % 3 = 1"), F.col("last") + 1, end + timedelta(days=1)))
    # One frame of another session, two years later, moves the watermark behind all silence.
    batches.append(sent(spark.range(1).select(F.lit(-1).cast("long").alias("session")), F.lit(0).cast("long"), end + timedelta(days=730)))
    make = lambda s: I.sessions(s.withWatermark("at", "1 hour"), bounds, "sh1_law", telemetry.PRE, telemetry.POST, 365 * DAY, 3650 * DAY)
    with I.rocksdb(spark):
        rows = batched_stream(spark, batches, make).where("session >= 0")
    event = lambda key: F.col("event")[key]
    return rows.select("kind", "session", "frame_id", "verdict", "reason", "breach", event("l_inf").alias("l_inf"), event("bound").alias("limit_"), event("k").alias("k"), event("envelope_shard_id").alias("cites"), "kept_from", "kept_to", "frames", "closed_by")


@query("streaming_keep_window", f"{telemetry.KEPT} SELECT session, frame_id FROM k WHERE kept")
def streaming_keep_window(spark, d):
    """The kept frames of ``keep_window_extend``, from a stream."""
    frames = telemetry.frames(spark, d).select("session", "frame_id", (F.col("action") == "error").alias("trigger"))
    return ended_stream(spark, frames, lambda s: S.keep_extending(s, telemetry.PRE, telemetry.POST))


@query("streaming_chain", f"WITH RECURSIVE {evidence.CHAIN} SELECT session, frame_id, h AS payload_sha256, chain FROM c")
def streaming_chain(spark, d):
    """All links of the chains that ``hash_chain_fold`` ends, from a stream."""
    frames = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("frame_id"), F.sha2("text", 256).alias("payload_sha256"))
    return ended_stream(spark, frames, S.chain)


#: Of each shard: the first batch that puts it in, and the flush whose response is good, by the first digit of its digest.
QUEUED = """WITH s AS (SELECT sha256(text) AS digest, min(doc_id % 2) AS batch FROM documents WHERE text IS NOT NULL GROUP BY 1),
r AS (SELECT digest, batch, ('0x' || digest[1])::int % 4 AS good FROM s),
o AS (SELECT *, good < 3 AND good >= batch AS anchored FROM r)
SELECT 'sh1_' || digest AS shard_id, digest AS manifest_sha256, 59 AS query_bytes, CASE WHEN anchored THEN 'ANCHORED' ELSE 'PENDING' END AS state, CASE WHEN anchored THEN good - batch + 1 ELSE 3 - batch END AS attempts,
 CASE WHEN anchored THEN 'tsa-' || good END AS authority, CASE WHEN anchored THEN '2024-01-0' || (good + 1) || 'T12:00:00Z' END AS anchored_at,
 CASE WHEN NOT anchored THEN CASE WHEN good = 3 THEN 'response without time' ELSE 'no response' END END AS error FROM o"""


@query("attestation_queue", QUEUED)
def attestation_queue(spark, d):
    """Documents as manifests, put in by a stream of two batches and tried by three flushes; the second batch holds all that the first
    one did, a batch and a flush are repeated."""
    at = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    note = lambda text: F.lit(text).cast("string")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("manifest"), F.col("source").alias("publisher_id"), note("2024-01-01T00:00:00Z").alias("created_at"), note(None).alias("queued_at"), note("breach").alias("note"))
    q = Q.Queue(spark, f"{at}/queue")

    def responses(flush):
        digit = F.conv(F.substring("manifest_sha256", 1, 1), 16, 10).cast("int") % 4
        time = F.unhex(F.concat(F.lit("180f"), F.hex(F.lit(f"2024010{flush + 1}120000Z"))))
        given = F.when(digit == flush, time).when(digit == 3, F.unhex(F.lit("30030201")))
        return q.listing().select("shard_id", F.lit(f"tsa-{flush}").alias("authority"), given.alias("response"))

    for number, rows in enumerate((docs.where("doc_id % 2 = 0"), docs)):
        Q.entries(rows).write.mode("append").parquet(f"{at}/sealed")
        stream = spark.readStream.schema("shard_id string, manifest_sha256 string, query binary, record string").parquet(f"{at}/sealed")
        q.fed_by(stream, f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        q.flush(responses(number), number)
    q.put(Q.entries(docs.where("doc_id % 2 = 0")), 0)
    q.flush(responses(1), 1)
    q.flush(responses(2), 2)
    return q.listing().select("shard_id", "manifest_sha256", F.octet_length("query").alias("query_bytes"), "state", "attempts", "authority", "anchored_at", "error")
